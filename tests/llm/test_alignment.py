"""Two tokenizers aligned, against whole texts encoded by the libraries and all pairs counted by hand."""
import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD, frame, words

from tidemark.llm import alignment

TRICKY = ["a\nb c", "a \n b", "two  spaces   and more", " lead", "trail ", "tab\tx y\t z", "don't stop 's end", "<|endoftext|> is <s> text </s> <unk> x", "mark▁inside text", "½ ﬁ ß 日本 語 🎉 x",
          "no break space　and\x1cmore \x85 y", "a b c", "12345 6 7.8 $x ...", "\n", " ", "é" * 40, "x\x00y z", "﻿b c", "é ö"]


def by_hand(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))
    shown = {}
    extra = 256
    for byte in range(256):
        if 33 <= byte < 127 or 161 <= byte < 173 or byte >= 174:
            shown[chr(byte)] = byte
        else:
            shown[chr(extra)] = byte
            extra += 1
    docs = []
    for key, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append((key, [], []))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            total, held = 0, []
            for p in parts:
                total += len(p)
                held.append(total)
            ends.append(held)
        common = sorted(set(ends[0]) & set(ends[1]))
        cut = [[[] for _ in common], [[] for _ in common]]
        for side, (ids, held) in enumerate(zip((ids_a, ids_b), ends)):
            for i, e in zip(ids, held):
                cut[side][bisect_left(common, e)].append(i)
        docs.append((key, cut[0], cut[1]))
    links = [Counter((x, y) for ga, gb in zip(da, db) for x in ga for y in gb) for _, da, db in docs]
    count = Counter(p for held in links for p in held)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (key, da, db), held in zip(docs, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(da, db))
        out.append((key, sum(map(len, da)), sum(map(len, db)), len(da), sum(held.values()), sum(n for p, n in held.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in held.items()), hashlib.sha256(text.encode()).hexdigest() if da else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    bits = [*TRICKY, " ", "  ", "\n", "'s", "a", ".", "é", "\t"]
    return ([(i + 100, t) for i, t in enumerate(TRICKY)] + [(i + 200, "".join(r.choice(bits) for _ in range(r.randint(1, 8)))) for i in range(150)]
            + [(i + 500, words(i % 20, 60)) for i in range(80)] + [(k, t) for k, t in ODD])


@pytest.mark.parametrize("chunk", [16_000_000, 3000])
def test_equals_whole_texts(llm, monkeypatch, rows, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "REMEMBERED", 40 if chunk < 10_000 else 300_000)
    got = sorted(map(repr, (tuple(r) for r in alignment.query(frame(llm, rows, extra=True)).collect())))
    assert got == sorted(map(repr, by_hand(rows)))


@pytest.mark.parametrize("block", [1, 500, 20_000])
def test_equals_whole_texts_in_small_blocks(llm, monkeypatch, rows, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "ASKED", 1 + block // 10)
    got = sorted(map(repr, (tuple(r) for r in alignment.query(frame(llm, rows).coalesce(1)).collect())))
    assert got == sorted(map(repr, by_hand(rows)))


def test_rows_of_a_chunk_stay_small(llm):
    """A chunk of millions of characters reaches Spark in rows of some hundred kilobytes, not in one."""
    texts = [(i, words(i, 1000)) for i in range(500)]
    assert sum(len(t) for _, t in texts) > 2_000_000
    found = alignment.chunks(frame(llm, texts).coalesce(1)).collect()
    assert sorted(k for r in found for k in r["ids"] or ()) == list(range(500))
    assert len({r["chunk"] for r in found}) == 1
    weight = lambda v: sum(map(weight, v)) if isinstance(v, list) else len(v) if isinstance(v, str | bytes | bytearray) else 8
    assert max(sum(map(weight, r)) for r in found) < 500_000


def test_many_empty_texts_are_no_endless_chunk(llm, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 30_000)
    found = alignment.chunks(frame(llm, [(i, None if i % 2 else "") for i in range(3000)]).coalesce(1)).collect()
    assert sorted(k for r in found for k in r["ids"]) == list(range(3000))
    assert len({r["chunk"] for r in found}) > 3


def test_chunks_without_links(llm, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 1)
    rows = [(1, None), (2, ""), (None, None), (4, ""), (5, "one two"), (6, "")]
    got = sorted(map(repr, (tuple(r) for r in alignment.query(frame(llm, rows).coalesce(1)).collect())))
    assert got == sorted(map(repr, by_hand([(k, t or "") for k, t in rows])))


def test_groups_are_the_whole_tokenizations(llm, rows):
    want = {k: (na, nb, n, sha) for k, na, nb, n, _, _, _, sha in by_hand(rows) if k is not None and k >= 100}
    for r in alignment.groups(frame(llm, rows)).collect():
        if r["doc_id"] in want:
            cut = list(zip(r["a_cuts"], r["b_cuts"]))
            text = ";".join(",".join(map(str, r["a_ids"][i:x])) + "|" + ",".join(map(str, r["b_ids"][j:y])) for (i, j), (x, y) in zip([(0, 0), *cut], cut))
            assert (len(r["a_ids"]), len(r["b_ids"]), len(cut), hashlib.sha256(text.encode()).hexdigest() if cut else "") == want[r["doc_id"]]


def test_galloping():
    r = np.random.default_rng(2)
    for _ in range(200):
        rows = [np.unique(r.integers(0, 90, r.integers(1, 40))) for _ in range(5)]
        start = np.cumsum([0, *map(len, rows)])
        owner = r.integers(0, 5, 30)
        wanted = np.array([r.integers(0, rows[k][-1] + 1) for k in owner])
        found = alignment.gallop(wanted, np.concatenate(rows), start[owner], start[owner + 1])
        assert (found - start[owner]).tolist() == [int(np.searchsorted(rows[k], x)) for k, x in zip(owner, wanted)]


def test_empty_table(llm):
    assert alignment.query(frame(llm, [])).collect() == []
