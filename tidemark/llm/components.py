"""Connected components of an edge table, as joins and aggregates.

Each round every node moves to the neighbour (or itself) with the smallest hash for
that round, edges follow their ends and loops fall away.  Fresh hashes make long
chains shrink by a constant share a round.  Every round's moves and edges are
written to the shared folder, so a lost executor repeats one round at most; only the
number of edges left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); equal roots mean connected.

    The root is one of the component's nodes, not a particular one.  Loops, repeated
    and reversed edges are allowed; an empty table gives no rows.
    """
    left = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while left.take(1):
        rank = lambda c, turn=len(moves): F.xxhash64(F.lit(turn), F.col(c))
        both = left.union(left.select("b", "a")).withColumn("rank", rank("b"))
        best = both.groupBy("a").agg(F.min_by("b", "rank").alias("b"), F.min("rank").alias("rank"))
        move = cut(best.select(F.col("a").alias("node"), F.when(rank("a") <= F.col("rank"), F.col("a")).otherwise(F.col("b")).alias("to")))
        moves.append(move)
        first = left.join(move, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        second = first.join(move, F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
        left = cut(second.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1].withColumnRenamed("to", "root")
    for move in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("at"), "root")
        found = move.join(later, F.col("to") == F.col("at"), "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
