"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint comes from XXH64 (seed 42) of its 4-word shingles.  Equal
fingerprints are folded first.  Two fingerprints within ``RADIUS`` = 4 bits agree on
at least two of six bit groups, so every pair of groups is a bucket key: no linked pair
is missed, and no bucket is near the whole table.  Inside a bucket fingerprints are
ordered by population count and compared tile against tile with exclusive-or and bit
counts; tile pairs whose counts differ by more than the radius cannot link and are
skipped.  A bucket of more than ``TILE`` rows is split into tiles by population count
and hash, and each pair of tiles that can link is a task's unit of its own.  Units give
spanning trees of their links, never all pairs; components are joined over the cluster.

Words are runs of anything but space and \\x09-\\x0D, with A-Z lower-cased; fewer than
four words are one shingle; null, empty and blank texts have fingerprint zero and link
like any other.  Repeated rows come out each.  A null doc_id takes part, but a
component is named by its smallest non-null doc_id.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut, slices, texts_of
from tidemark.llm.components import components
from tidemark.llm.tiles import SMALL, TILE, Forest, by_unit, small_pairs

SHINGLE, SEED, RADIUS = 4, 42, 4
#: First bit and width of the bit groups; two of RADIUS + 2 groups are free of differing bits.
GROUPS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_BLOCK, _LANE, _COMPARE = 1 << 22, np.uint64(0x0101010101010101), 256


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every shingle, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]])
    parts = map(whole.__getitem__, map(slice, starts.tolist(), (ends[SHINGLE - 1:] - 1).tolist()))
    return list(map(xxhash.xxh64_intdigest, parts, repeat(SEED)))


def fingerprints(texts: list[str]) -> np.ndarray:
    """One unsigned fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices(map(len, texts), _BLOCK):
        hashes, sizes = [], []
        for text in texts[a:b]:
            found = np.array(shingle_hashes(text), np.uint64)
            hashes.append(found)
            sizes.append(len(found))
        owner = np.flatnonzero(sizes)
        if not len(owner):
            continue
        h, n = np.concatenate(hashes), np.array(sizes)[owner]
        first = np.cumsum(np.r_[0, n[:-1]])
        pieces = -(-n // 255)  # a byte lane holds 255
        piece_first = np.cumsum(np.r_[0, pieces[:-1]])
        within = np.arange(pieces.sum()) - np.repeat(piece_first, pieces)
        cuts = np.repeat(first, pieces) + 255 * within
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANE, cuts)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_first, axis=0)
            for byte in range(8):
                out[a + owner] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, print): a hash of the text and the fingerprint as a signed long, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(fingerprints(texts_of(batch)).view(np.int64))], ["doc_id", "mark", "print"])
    text = F.col("text").cast("string")
    return arrow_rows(docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text")), work, f"doc_id {kind}, mark long, print long")


def _units(prints: DataFrame) -> DataFrame:
    """Every distinct fingerprint in the units in which it may meet another."""
    def bits(first: int, width: int):
        return F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for k, (g, h) in enumerate(combinations(GROUPS, 2)):
        keys.append(F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(bits(*g), 11)).bitwiseOR(bits(*h)))
    rows = prints.select("print", F.bit_count("print").alias("ones"), F.explode(F.array(*keys)).alias("key"))
    spread = (rows.groupBy("key", "ones").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
              .agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("spread")).where("total > 1"))
    near = f"sequence(greatest(ones - {RADIUS}, 0), least(ones + {RADIUS}, 64))"
    parts = f"cast(ceil(coalesce(spread[p], 0) / {TILE}) as int)"
    tile = f"cast(ones * 1048576 + pmod(xxhash64(print), ceil(spread[ones] / {TILE})) as long)"
    others = f"flatten(transform({near}, p -> transform(filter(sequence(0, {parts}), s -> s < {parts}), s -> cast(p * 1048576 + s as long))))"
    placed = rows.join(spread, "key").select(
        "key", "print", "ones", F.expr(f"if(total <= {TILE}, 0L, {tile})").alias("tile"), F.expr(f"if(total <= {TILE}, array(0L), {others})").alias("others"))
    return placed.select("key", "print", "tile", F.explode("others").alias("other")).select(
        "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "print")


def compare(prints: np.ndarray, split: int, forest: Forest, offset: int = 0) -> None:
    """Join linked rows: all pairs if ``split`` is 0, else rows before against rows from ``split``."""
    ones = np.bitwise_count(prints).astype(np.int64)
    left, right = (np.arange(len(prints)),) * 2 if not split else (np.arange(split), np.arange(split, len(prints)))
    left, right = (side[np.argsort(ones[side], kind="stable")] for side in (left, right))
    for a in range(0, len(left), _COMPARE):
        rows = left[a:a + _COMPARE]
        for b in range(0 if split else a, len(right), _COMPARE):
            cols = right[b:b + _COMPARE]
            if ones[cols[0]] - ones[rows[-1]] > RADIUS:
                break
            if ones[rows[0]] - ones[cols[-1]] > RADIUS:
                continue
            i, j = np.nonzero(np.bitwise_count(prints[rows][:, None] ^ prints[cols][None, :]) <= RADIUS)
            forest.join(rows[i] + offset, cols[j] + offset)


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints connected by links of at most ``RADIUS`` bits."""
    def work(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        rows = part.column("print").to_numpy().astype(np.int64).view(np.uint64)
        tile = part.column("tile").to_numpy()
        i, j = small_pairs(starts)
        near = (np.bitwise_count(rows[i] ^ rows[j]) <= RADIUS) & ((part.column("low").to_numpy() == part.column("high").to_numpy())[i] | (tile[i] != tile[j]))
        a, b = [rows[i[near]]], [rows[j[near]]]
        for k in np.flatnonzero(np.diff(starts) > SMALL):
            group = slice(starts[k], starts[k + 1])
            one = part.column("low")[int(starts[k])] == part.column("high")[int(starts[k])]
            split = 0 if one else int(np.searchsorted(tile[group], tile[starts[k]], side="right"))
            if not one and split == starts[k + 1] - starts[k]:
                continue  # the other tile is empty here
            forest = Forest(starts[k + 1] - starts[k])
            compare(rows[group], split, forest)
            child, root = forest.edges()
            a.append(rows[group][child])
            b.append(rows[group][root])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    return by_unit(_units(prints), work, "a long, b long")


def clustered(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, print, root, component_id) for every row; equal roots are one component."""
    every = cut(fingerprinted(docs))
    first = every.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("print")))
    rooted = cut(first.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(named, "root").select("print", "root", "component_id")
    return every.join(member, "print").select("doc_id", "mark", "print", "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of every component: of the rows with its smallest doc_id the one first by a hash of text and row.

    A component without any doc_id keeps one of its rows, chosen alike.  Rows that share
    doc_id and text are folded before texts are shuffled, and the choice joins them where they are.
    """
    key = F.xxhash64(F.lit("id"), "doc_id").alias("key")
    best = clustered(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("best"))
    chosen = best.select("best.doc_id", F.col("best.mark").alias("mark")).select(key, "mark").distinct()
    row = F.struct(*docs.columns)
    rows = docs.select(key, F.xxhash64(F.col("text").cast("string")).alias("mark"), row.alias("row"))
    once = rows.groupBy("key", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.join(chosen, ["key", "mark"], "left_semi").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return clustered(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
