"""SimHash, near vectors and exact top-k against brute force, with hot groups and small tiles."""
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import ODD, frame, words

from tidemark.llm import components, nearvec, simhash, tiles, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + 4]) for i in range(max(1, len(parts) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, j in links:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("tile", [1024, 16])
def test_simhash_equals_brute_force(llm, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r, rows = random.Random(1), []
    base = words(0, 60).split()
    for i in range(400):
        if i % 3 == 0:  # one large group of near copies
            parts = list(base)
            for _ in range(r.randint(0, 3)):
                parts[r.randrange(60)] = r.choice(base)
            rows.append((i, " ".join(parts)))
        elif i % 3 == 1:
            rows.append((i, words(i % 50, 40)))
        else:
            rows.append((i, words(i, r.randint(0, 5))))
    got = {r["doc_id"]: r for r in simhash.query(frame(llm, rows)).collect()}
    prints = [plain_print(t) for _, t in rows]
    assert [int(got[i]["fingerprint"], 16) for i in range(400)] == prints
    root = groups(400, [(i, j) for i in range(400) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    first = {}
    for i, k in enumerate(root):
        first[k] = min(i, first.get(k, i))
    assert [got[i]["component_id"] for i in range(400)] == [first[k] for k in root]
    kept = simhash.representatives(frame(llm, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(first.values()))


def test_every_pair_within_four_bits_shares_a_bucket(llm):
    r, pairs = random.Random(4), []
    for _ in range(300):
        x = r.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in r.sample(range(64), 4))))
    rows = [(int(np.uint64(x).astype(np.int64)),) for p in pairs for x in p]
    found = {frozenset(t) for t in simhash.links(llm.createDataFrame(rows, "print long")).collect()}
    assert all(frozenset(int(np.uint64(x).astype(np.int64)) for x in p) in found for p in pairs)


def test_components_of_chains_and_stars(llm):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (3000, 2999)]
    got = {r["node"]: r["root"] for r in components.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1
    assert len(set(got.values())) == 3
    assert components.components(llm.createDataFrame([], "a long, b long")).count() == 0


def vectors(n, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, 16))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = centre[0]  # a third of all rows: one vector
        elif i % 3 == 1:
            v = centre[i % 6] + r.normal(size=16) * 0.06
        else:
            v = r.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    return rows


ODD_VECTORS = [(None, [1.0] * 16, 0), (9001, None, 0), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1),
               (9005, [1.0] * 16, None), (9006, [], 0), (9007, [float("inf")] * 16, 0), (9050, [2.0] * 3, 0), (9051, [1.0] * 3, 0)]


@pytest.mark.parametrize("tile", [1024, 20])
def test_near_vectors_equal_sql(llm, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = vectors(450, 2) + ODD_VECTORS
    got = sorted(map(str, map(tuple, nearvec.query(llm.createDataFrame(rows, VECTORS)).collect())))
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert got == sorted(map(str, con.execute(nearvec.SQL).fetchall()))


@pytest.mark.parametrize("size", [(8192, 4096), (40, 3)])
def test_top_k_equals_sql(llm, monkeypatch, size):
    monkeypatch.setattr(topk, "BUCKET", size[0])
    monkeypatch.setattr(topk, "QUERIES", size[1])
    rows = [(i, [x * (1 + i % 7) for x in v], lab) for i, v, lab in vectors(600, 5)] + ODD_VECTORS
    got = sorted(tuple(r) for r in topk.query(llm.createDataFrame(rows, VECTORS)).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert got == sorted(con.execute(topk.SQL).fetchall())


def test_coordinate_pruning_keeps_every_candidate():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(3000, 8)) * 50)
    bucket, q = topk.Bucket(np.arange(3000), x), np.floor(r.normal(size=8) * 50)
    size, lengths = np.linalg.norm(q), np.linalg.norm(x, axis=1)
    for cosine in (0.2, 0.6, 0.9, 0.99):
        held = set(bucket.ids[bucket.feasible(q, size, cosine)])
        assert set(np.flatnonzero(x @ q >= cosine * size * lengths)) <= held
    assert len(bucket.feasible(q, size, 0.95)) < 2500


def test_odd_rows(llm):
    for extra in (False, True):
        docs = frame(llm, ODD, extra)
        got = simhash.query(docs).collect()
        assert len(got) == len(ODD)
        zero = [r for r in got if r["fingerprint"] == "0" * 16]
        assert {r["doc_id"] for r in zero} == {None, 1, 2, 3} and {r["component_id"] for r in zero} == {1}
        kept = simhash.representatives(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.query(frame(llm, [])).count() == 0 and simhash.representatives(frame(llm, [])).count() == 0
    none = llm.createDataFrame([], VECTORS)
    assert nearvec.query(none).count() == 0 and topk.query(none).count() == 0


def test_repeated_vectors(llm):
    rows = [(50, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (8, [-1.0, 2.0], 1)]
    frame_ = llm.createDataFrame(rows, VECTORS)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in nearvec.query(frame_).collect()) == [(7, 2, 7), (8, 0, 8), (50, 2, 7), (50, 2, 7)]
    assert [(r["rank"], r["vec_id"]) for r in topk.query(frame_).orderBy("rank").collect()] == [(1, 7), (2, 8)]
