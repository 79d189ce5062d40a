"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors of a label are folded to one first.  Each of ``TABLES`` tables hashes a
vector to the signs of ``BITS`` fixed random planes; vectors that share label, length and
signs in any table are compared by their exact cosine in double precision.  A link at
the threshold 0.98 has an angle of 0.2003, so it differs in one sign with probability
0.0638 and is met in at least one table with probability 0.9998; wider links never
count, closer ones are met more surely.  A bucket of any size is dealt into tiles and
each pair of tiles is a unit of its own, so no pair of a bucket is left out.  Units give
link counts and spanning trees, not pairs; a pair that several tables meet counts in the
first of them only.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label or vec_id, link with nothing: n_links 0, component_id their own id.
Repeated rows count as further vectors.  Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut
from tidemark.llm.components import components
from tidemark.llm.tiles import SMALL, Forest, by_unit, halves, small_pairs

BITS, TABLES, LEAST, SEED = 10, 12, 0.98, 20
_COMPARE = 256


def usable(name: str) -> Column:
    """True if the vector has components, all of them finite numbers."""
    odd = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(name) > 0) & ~odd, F.lit(False))


@lru_cache(maxsize=16)
def planes(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, TABLES * BITS))


def codes(vectors: np.ndarray) -> np.ndarray:
    """Sign codes, one column a table."""
    signs = (vectors @ planes(vectors.shape[1]) > 0).reshape(len(vectors), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(2).astype(np.int16)


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a list column as arrays in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])


def packed(vectors: list[np.ndarray]) -> list[bytes]:
    """Vectors as single-precision bytes where that loses nothing, else in double precision."""
    short = [v.astype(np.float32) for v in vectors]
    return [(s if (s == v).all() else v).tobytes() for s, v in zip(short, vectors)]


def unpacked(data: list[bytes], size: int) -> np.ndarray:
    """Rows of doubles from ``packed`` vectors of one length."""
    kinds = set(map(len, data))
    if len(kinds) == 1:
        return np.frombuffer(b"".join(data), np.float32 if kinds == {4 * size} else np.float64).reshape(len(data), size).astype(np.float64)
    return np.stack([np.frombuffer(p, np.float32 if len(p) == 4 * size else np.float64).astype(np.float64) for p in data])


def _coded(reps: DataFrame) -> DataFrame:
    """(node, label, times, size, codes array, packed vector) of each distinct vector."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = rows_of(batch.column("vec"))
        size = np.array([len(v) for v in vectors])
        found = np.zeros((len(vectors), TABLES), np.int16)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            found[at] = codes(np.stack([vectors[i] for i in at]))
        return pa.record_batch([batch.column("node"), batch.column("label"), batch.column("times"), pa.array(size, pa.int32()), pa.array(found.tolist(), pa.list_(pa.int16())),
                                pa.array(packed(vectors), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())],
                               ["node", "label", "times", "size", "codes", "vec", "signs"])
    kind = reps.schema["label"].dataType.simpleString()
    return arrow_rows(reps, work, f"node long, label {kind}, times long, size int, codes array<short>, vec binary, signs binary")


def _pairs(unit: np.ndarray, split: int, least: float):
    """Row pairs of a unit with cosine at or above ``least``; ``unit`` has rows of length one."""
    left, right = (unit, unit) if not split else (unit[:split], unit[split:])
    for a in range(0, len(left), _COMPARE):
        for b in range(0 if split else a, len(right), _COMPARE):
            i, j = np.nonzero(left[a:a + _COMPARE] @ right[b:b + _COMPARE].T >= least)
            i, j = i + a, j + b
            yield (i, j + split) if split else (i[i < j], j[i < j])


def linked(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """(kind, a, b): kind 0 is a node with a number of linked vectors, kind 1 a tree edge."""
    coded = cut(_coded(reps))
    rows = coded.select("node", "times", "label", "size", "vec", "signs", F.posexplode("codes").alias("turn", "code"))
    keyed = rows.withColumn("key", F.xxhash64("label", "size", "turn", "code"))

    def work(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, times, turn = (part.column(c).to_numpy() for c in ("node", "times", "turn"))
        one = part.column("low").to_numpy() == part.column("high").to_numpy()
        tile = part.column("tile").to_numpy()
        signs = np.frombuffer(b"".join(part.column("signs").to_pylist()), np.int16).reshape(-1, TABLES)
        held = part.column("vec").to_pylist()
        sizes = part.column("size").to_numpy()
        label = part.column("label").to_numpy(zero_copy_only=False)
        kinds, firsts, seconds = [], [], []

        def vectors(a: int, b: int) -> np.ndarray:
            v = unpacked(held[a:b], int(sizes[a]))
            return v / np.linalg.norm(v, axis=1, keepdims=True)

        def once(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Pairs that no earlier table meets; a 64-bit key may join strangers, so signs and labels are checked."""
            same = signs[i] == signs[j]
            return (same.argmax(1) == turn[i]) & same.any(1) & (turn[i] == turn[j]) & (label[i] == label[j])

        def told(i: np.ndarray, j: np.ndarray, a: int, b: int) -> None:
            counts = np.bincount(i - a, times[j], b - a) + np.bincount(j - a, times[i], b - a)
            some = np.flatnonzero(counts)
            kinds.append(np.zeros(len(some), np.int32)), firsts.append(node[a + some]), seconds.append(counts[some].astype(np.int64))

        i, j = small_pairs(starts)
        fit = one[i] | (tile[i] != tile[j])
        i, j = i[fit], j[fit]
        if len(i):
            dots = np.zeros(len(i))
            for n in np.unique(sizes[i]):
                at = np.flatnonzero((sizes[i] == n) & (sizes[j] == n))
                x, y = (unpacked([held[k] for k in side[at]], int(n)) for side in (i, j))
                dots[at] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            near = (dots >= least) & once(i, j)
            i, j = i[near], j[near]
            if len(i):
                told(i, j, 0, len(node))
                kinds.append(np.ones(len(i), np.int32)), firsts.append(node[i]), seconds.append(node[j])
        for k in np.flatnonzero(np.diff(starts) > SMALL):
            a, b = int(starts[k]), int(starts[k + 1])
            split = 0 if one[a] else int(np.searchsorted(tile[a:b], tile[a], side="right"))
            if (not one[a] and split == b - a) or len(set(sizes[a:b])) > 1:
                continue
            forest = Forest(b - a)
            for i, j in _pairs(vectors(a, b), split, least):
                fresh = once(i + a, j + a)
                i, j = i[fresh], j[fresh]
                forest.join(i, j)
                if len(i):
                    told(i + a, j + a, a, b)
            child, root = forest.edges()
            kinds.append(np.ones(len(child), np.int32)), firsts.append(node[a + child]), seconds.append(node[a + root])
        if not kinds:
            kinds, firsts, seconds = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        return pa.record_batch([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(firsts).astype(np.int64)), pa.array(np.concatenate(seconds).astype(np.int64))], ["kind", "a", "b"])
    return by_unit(halves(keyed.drop("code")), work, "kind int, a long, b long")


def clustered(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    base = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    fit = usable("vec") & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    told = base.withColumn("fit", F.coalesce(fit, F.lit(False)))
    mark = F.struct(F.xxhash64("vec").alias("x"), F.xxhash64(F.lit("again"), "vec").alias("y"), F.size("vec").alias("n"))
    told = told.withColumn("mark", F.when(F.col("fit"), mark))
    reps = (told.where("fit").groupBy("label", "mark").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times"), F.first("vec").alias("vec")))
    reps = cut(reps.select(F.col("node").cast("long").alias("node"), "label", "mark", "times", "vec"))
    found = cut(linked(reps.select("node", "label", "times", "vec"), least))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select("a", "b")).select("node", "root")
    rooted = cut(reps.drop("vec").join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "mark", "node", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = rooted.groupBy("root").agg(F.min("node").alias("component_id"))
    member = rooted.join(named, "root").select("label", "mark", "n_links", "component_id")
    kind = vectors.schema["vec_id"].dataType
    every = told.where("fit").select("vec_id", "label", "mark").join(member, ["label", "mark"]).select("vec_id", "n_links", F.col("component_id").cast(kind).alias("component_id"))
    alone = told.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return every.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(vectors: DataFrame) -> DataFrame:
    return clustered(vectors)


#: The same links and components from all pairs of a label.
SQL = """
with recursive v as (
  select vec_id, label, case when label is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    then list_transform(embedding, lambda x: x::double) end as e from embeddings
), u as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v where e is not null
), pairs as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (a.size * b.size) end >= 0.98
), reach(a, b) as (select vec_id, vec_id from v union select r.a, p.b from reach r join pairs p on r.b = p.a
), named as (select a as vec_id, min(b) as component_id from reach group by a
), counted as (select a as vec_id, count(*) as n from pairs group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from named left join counted using (vec_id)
"""
