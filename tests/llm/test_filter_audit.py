"""The filter audit against a plain walk of every order, and its SQL; tries against dictionaries."""
import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from conftest import ODD, frame, words

from tidemark.llm import filteraudit


def failing(rows):
    """(doc_id, part, mask) straight from the rule."""
    out = []
    for key, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in rows)
        bits = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), copy)
        out.append((key, lang or "", sum(1 << i for i, b in enumerate(bits) if b)))
    return out


def walked(rows, good, toxic):
    found, shapley = defaultdict(lambda: [0] * 6), defaultdict(int)
    masks = failing(rows)
    for order in map("".join, permutations("ABCDE")):
        for key, part, mask in masks:
            gone = False
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                cell = found[part, order, step]
                if mask & bit:
                    cell[2 if gone else 1] += 1
                    if not gone:
                        shapley[part, f] += 1
                        cell[4] += key in good
                        cell[5] += key in toxic
                    gone = True
                cell[0] += not gone
                cell[3] += mask == bit
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    head, out = "Shared opening words of many texts. " * 9, []
    hot = head + words(1, 300)
    for i in range(240):
        text = hot if i % 3 == 0 else r.choice(["", head, head * 2]) + words(i % 60, r.choice([3, 120, 260])) + r.choice(["", " 50 %", " ABC DEF" * 12, " same same" * 300])
        out.append((r.choice([i, i, i, i - 1]), text, r.choice(["en", "fr", None])))
    return out + [(k, t, "en") for k, t in ODD] + [(9, "x", "de"), (9, "x", None), (9, "y", "de")]


LABELS = [(1, 1, 0), (2, None, 1), (3, 1, 1), (3, 0, None), (4, 0, 0), (None, 1, 1), (60, 1, 0), (63, 1, 1), (999, 1, 1)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_every_order_walked(llm, monkeypatch, rows, small):
    if small:
        monkeypatch.setattr(filteraudit, "FOLD", 2000)
        monkeypatch.setattr(filteraudit, "PARTITION", 4000)
        monkeypatch.setattr(filteraudit, "SHARED", 1500)
    labels = llm.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in filteraudit.query(frame(llm, rows, extra=True), labels).collect())
    assert got == walked(rows, {1, 3, 60, 63, 999}, {2, 3, 63, 999})


def test_sql(llm, rows):
    con = duckdb.connect()
    documents = frame(llm, rows).toPandas()
    labels = llm.createDataFrame(LABELS, "doc_id long, quality int, toxic int").toPandas()
    for name, t in (("documents", documents), ("labels", labels)):
        con.register(f"{name}_", t)
    con.execute("create view documents as select cast(nullif(doc_id, 'nan') as bigint) as doc_id, text, lang from documents_")
    con.execute("create view labels as select cast(nullif(doc_id, 'nan') as bigint) as doc_id, quality, toxic from labels_")
    cur = con.execute(filteraudit.SQL)
    at = [[d[0] for d in cur.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[i] for i in at) for r in cur.fetchall()) == walked(rows, {1, 3, 60, 63, 999}, {2, 3, 63, 999})


def test_masks_by_document(llm, rows):
    got = []
    for r in filteraudit.masks(frame(llm, rows)).collect():
        got += [(r["doc_id"], r["part"], r["mask"])] * r["n"]
    assert sorted(got, key=repr) == sorted(failing(rows), key=repr)


def test_hot_prefixes_are_split(llm, rows):
    from pyspark.sql import functions as F
    texts = frame(llm, rows).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = filteraudit.shared_prefixes(texts, 4000)
    assert len(found) > 3 and [n for n, _ in found] == [16 << i for i in range(len(found))]


def test_trie_is_a_dictionary():
    r = random.Random(6)
    trie, held = filteraudit.Trie(), {}
    for i in range(3000):
        text, key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 14))), r.randint(0, 500)
        trie.insert(text, key, i)
        least, rows = held.get(text, (key, []))
        held[text] = min(least, key), [*rows, i]
    assert sorted(trie.terminals()) == sorted(held.values())


def test_empty_table(llm):
    assert filteraudit.query(frame(llm, []), llm.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
