"""Exact top-k inner products by norm buckets.

Vectors turn into integers floor(256 * x), are ordered by length and dealt into buckets
of about ``BUCKET`` rows.  Queries first meet the bucket of the longest vectors; their
k-th product there is a lower bound.  For every other bucket the bound divided by the
query's length and the bucket's longest vector is the cosine a candidate must reach: over
one, the query never goes there; from ``STEEP`` on the candidates are pruned by the
query's strongest coordinate, whose feasible interval follows from that cosine; below,
by length, so that only the longest candidates are multiplied.  What is left is verified
by exact products.  A unit is a bucket and a block of ``QUERIES`` queries.

Vectors that are null or empty, or hold null or non-finite components, and rows with a
null vec_id take no part; vectors of another length than the query's are no candidates.
A repeated query row is asked once (with its smallest vector), its vec_id is never its
own answer, repeated candidate rows are answered each.  Products must fit a long.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut
from tidemark.llm.nearvec import rows_of, usable
from tidemark.llm.tiles import by_unit

K, EVERY, SCALE = 5, 50, 256
BUCKET, QUERIES, STEEP = 8192, 4096, 0.6
_BLOCK = 256
_SLACK = 1 - 1e-9
_SCHEMA = "query_id long, vec_id long, score long"


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole numbers held as doubles."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (id, score) of one query, ties to smaller ids."""
    other = ids != own
    scores, ids = scores[other], ids[other]
    if len(ids) > k:
        few = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[few], ids[few]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Bucket:
    """Candidates of one bucket, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        length = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-length, kind="stable")
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by coordinate f of the vectors scaled to length one."""
        if f not in self.columns:
            x = np.divide(self.vectors[:, f], self.length, out=np.zeros(len(self.length)), where=self.length > 0)
            order = np.argsort(x, kind="stable")
            self.columns[f] = order, x[order]
        return self.columns[f]

    def feasible(self, query: np.ndarray, size: float, cosine: float) -> np.ndarray:
        """Rows whose strongest-coordinate value allows the cosine."""
        f = int(np.abs(query).argmax())
        q = query[f] / size
        wide = np.sqrt(max(0.0, (1 - q * q) * (1 - cosine * cosine))) + 1e-9
        low = q * cosine - wide if cosine > -q else -1.0
        high = q * cosine + wide if cosine > q else 1.0
        order, x = self.column(f)
        return order[np.searchsorted(x, low, "left"):np.searchsorted(x, high, "right")]

    def search(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int):
        """(query, ids, scores) of what may be among each query's k best."""
        size = np.linalg.norm(queries, axis=1)
        reach = size * (self.length[0] if len(self.length) else 0.0)
        cosine = np.where(bound > 0, bound * _SLACK / np.where(reach > 0, reach, 1), 0.0)
        cosine = np.where((bound > 0) & (reach == 0), 2.0, cosine)
        for i in np.flatnonzero((cosine >= STEEP) & (cosine <= 1)):
            rows = self.feasible(queries[i], size[i], cosine[i])
            rows = rows[self.length[rows] * size[i] >= bound[i] * _SLACK]
            yield ids[i], *_best(_products(queries[i:i + 1], self.vectors[rows])[0], self.ids[rows], ids[i], k)
        flat = np.flatnonzero(cosine < STEEP)
        need = np.where(bound[flat] > 0, bound[flat] * _SLACK / np.where(size[flat] > 0, size[flat], 1), -1.0)
        flat = flat[np.argsort(-need, kind="stable")]  # queries that look equally deep go together
        need = -np.sort(-need, kind="stable")
        for a in range(0, len(flat), _BLOCK):
            at = flat[a:a + _BLOCK]
            deep = int(np.searchsorted(-self.length, -need[a:a + _BLOCK].min(), "right"))
            scores = _products(queries[at], self.vectors[:deep])
            for i, row in zip(at, scores):
                yield ids[i], *_best(row, self.ids[:deep], ids[i], k)


def _search(rows: DataFrame, k: int) -> DataFrame:
    """Best candidates of every unit of rows (key, low, high, tile, id, vec, bound); tile 0 holds the bucket."""
    def work(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        part = part.combine_chunks()
        tile, ids = part.column("tile").to_numpy(), part.column("id").to_numpy()
        bound = part.column("bound").to_numpy()
        vectors = rows_of(part.column("vec").combine_chunks())
        size = np.array([len(v) for v in vectors])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(starts[:-1], starts[1:]):
            for n in np.unique(size[a:b]):
                at = a + np.flatnonzero(size[a:b] == n)
                held, asked = at[tile[at] == 0], at[tile[at] == 1]
                if len(held) and len(asked):
                    bucket = Bucket(ids[held], np.stack([vectors[i] for i in held]))
                    for q, x, s in bucket.search(ids[asked], np.stack([vectors[i] for i in asked]), bound[asked], k):
                        found.append((np.full(len(x), q, np.int64), x, s))
        columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ()))]
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])
    return by_unit(rows, work, _SCHEMA)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding); queries are by default the rows whose id is divisible by ``EVERY``."""
    def whole(frame: DataFrame) -> DataFrame:
        some = frame.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("raw")).where(F.col("vec_id").isNotNull() & usable("raw"))
        return some.select("id", F.transform("raw", lambda x: F.floor(x * SCALE).cast("double")).alias("vec"))
    held = whole(vectors).withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    count = held.count()
    ranged = held.repartitionByRange(max(1, -(-count // BUCKET)), F.col("length").desc(), "id").withColumn("bucket", F.spark_partition_id().cast("long"))
    ranged = cut(ranged)
    longest = ranged.groupBy("bucket").agg(F.max("length").alias("longest"))
    first, last = longest.agg(F.min("bucket"), F.max("bucket")).first()
    asked = whole(queries) if queries is not None else ranged.where(F.pmod("id", F.lit(EVERY)) == 0)
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("size", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("low", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    nothing = F.lit(float("-inf"))

    def units(candidates: DataFrame, questions: DataFrame) -> DataFrame:
        spread = candidates.select(F.col("bucket").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("low"),
                                   F.lit(0).alias("tile"), "id", "vec", nothing.alias("bound"))
        return spread.union(questions.select("key", "low", F.lit(1).alias("tile"), "id", "vec", "bound")).withColumn("high", F.col("low"))
    if first is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    seeds = cut(_search(units(ranged.where(F.col("bucket") == first), asked.withColumn("key", F.lit(first)).withColumn("bound", nothing)), k))
    bound = _top(seeds, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("found"))
    ready = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("found", nothing))
    onward = ready.withColumn("key", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))).where(F.col("key") != first)
    onward = onward.join(longest.withColumnRenamed("bucket", "key"), "key").where(F.col("size") * F.col("longest") >= F.col("bound") * _SLACK)
    rest = _search(units(ranged.where(F.col("bucket") != first), onward), k)
    return _top(seeds.union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, case when len(q.e) = len(c.e) then list_dot_product(q.e, c.e)::bigint end as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored where score is not null
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
