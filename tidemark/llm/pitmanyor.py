"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are lower-cased (A-Z) words and one end a document.  Every context is a
restaurant: the start of a document and every word that precedes another one in training.
They share one parent, the restaurant of single words, whose
base is uniform over the V training words and the unknown word.

Customers of a dish (word) in a restaurant sit at tables, and each table is one customer
of the dish in the parent.  Seatings are sampled by Gibbs: a dish's tables in one
restaurant are drawn anew given the parent's prediction without them, for up to
``EXACT`` customers from the exact conditional law of the number of tables (generalised
Stirling numbers), beyond that by seating the customers in arriving blocks of a
twentieth.  A dish with one customer has one table, so only pairs that occur twice or more
are rows of the sampler.  A job joins them with the totals of their word and of their
context, which stand in one table by word and are those of the job before.  Every draw
is keyed by its word, context, job and sweep and sees nothing of other rows of its job,
so scores are the same however rows are dealt to tasks.  Discounts are estimated
from the counts of counts.  After a seating job and a burn-in job, ``SAMPLES`` sweeps are
averaged, and P(w | u) = (n - d t) / (theta + C) + (theta + d T) / (theta + C) P(w) with the
averages is again a distribution.  C is how often u occurs, as each word but the end has a
word after it; the end stands for the start of a document.

Texts are read and split once, into chunks of about ``CHUNK`` characters with their own
word lists.  Counts are summed over chunks, and what the model says of a chunk's words
and pairs is led back to it, so no task needs the vocabulary.  Words are known by their
64-bit XXH64; two words of one hash would count as one.

A pair crosses the shuffle as a 64-bit hash of its two words.  A chunk sorts its pairs' hashes,
an eighth of their range at a time, so a task holds little beyond its tokens and their scores,
and cuts them into blocks, ranges of about ``BLOCK`` tokens of the whole corpus; a row holds
the differences of a chunk's hashes in a block, about six bytes a pair.  A task adds a
block up over the chunks and tells each chunk the totals in the order in which they came; of
the blocks it keeps which of its repeated pairs, by the order of their hashes, each entry
is, about a byte an entry, by which the sampler's results find their way back.  Words cross
and their results come back the same way, in blocks of ``WORD_BLOCK`` tokens.
As hashes are even, so are blocks, however often a word or a pair occurs.  Two pairs of one hash
would count as one: of four thousand million pairs, as in 30 GB, that is expected of less than one.

Null and empty texts are the end alone.  Without training text every word is unknown
and both scores are zero.  Repeated rows are counted and answered each; a null doc_id
counts as the empty text when rows are split into training and held-out ones.  Only
doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, remainder, texts_of
from tidemark.session import discard

HELD_OUT, CHUNK = 7, 24_000_000
EXACT, BURN, SAMPLES, SEED = 64, 2, 3, 8
STRENGTH = 1.0  # theta of every restaurant
#: Rows that a task of the sampler takes at once, and that a chunk gives at once; tokens that are scored at once.
WORD_ROWS, GIVEN, SCORED = 16_384, 100_000, 500_000
#: Tokens to a block of pairs, and to one of words; ranges of pair hashes that a chunk sorts one after the other.
BLOCK, WORD_BLOCK, RANGES = 1_000_000, 4_000_000, 8
_END = b""
#: The end's hash, which is the start of a document as a context.
START = int(np.array([xxhash.xxh64_intdigest(_END)], np.uint64).view(np.int64)[0])
#: A word's customers less its tables' discounts in one restaurant.
_OWN = np.dtype([("context", "<i4"), ("own", "<f4")])


class _Index(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of their width."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes | pa.Buffer, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    return flat.reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(kind, copy=False)


def own_counts(data: bytes) -> np.ndarray:
    """(context, own) entries of a word's row."""
    return np.frombuffer(data, _OWN)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row a chunk: doc_ids, held flags, token counts, token numbers, word hashes and training counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_ids", "held", "lengths", "tokens", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        index, ids, held, lengths, tokens, chars = _Index(), [], [], [], [], 0

        def row() -> pa.RecordBatch:
            all_ids = pa.concat_arrays(ids)
            flat = np.concatenate(tokens)
            learnt = np.repeat(~np.array(held), lengths)
            counts = np.bincount(flat[learnt], minlength=len(index))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), x) for x in (all_ids, pa.array(held), pa.array(lengths, pa.int32()))]
            return pa.record_batch([pa.array([number]), *lists, *(pa.array([b], pa.binary()) for b in (_packed(flat), hashes.tobytes(), _packed(counts)))], names)

        for batch in batches:
            start = 0
            flags = batch.column("held").to_pylist()
            for i, text in enumerate(texts_of(batch)):
                words = text.encode("utf-8", "replace").lower().split()
                words.append(_END)
                tokens.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                held.append(flags[i]), lengths.append(len(words))
                chars += len(text)
                if chars >= size:
                    ids.append(batch.column("doc_id").slice(start, i + 1 - start))
                    start = i + 1
                    yield row()
                    number += 1
                    index, ids, held, lengths, tokens, chars = _Index(), [], [], [], [], 0
            if start < batch.num_rows:
                ids.append(batch.column("doc_id").slice(start))
        if held:
            yield row()
    source = docs.select("doc_id", (remainder("doc_id", HELD_OUT) == 2).alias("held"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"chunk long, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, tokens binary, words binary, counts binary")


def _each(frame: DataFrame, work, schema: str, given: int = GIVEN) -> DataFrame:
    """Arrow rows from each chunk row, ``given`` at once; ``work`` gives batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for out in work({c: batch.column(c)[k].as_py() for c in batch.schema.names}):
                    yield from (out.slice(a, given) for a in range(0, out.num_rows, given))
    return frame.mapInArrow(run, schema)


def _in_runs(frame: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on runs of about ``WORD_ROWS`` rows, whatever the session's batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WORD_ROWS:
                yield work(pa.concat_batches(held))
                held, rows = [], 0
        if rows:
            yield work(pa.concat_batches(held))
    return frame.mapInArrow(run, schema)


@contextmanager
def _wide_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``WORD_ROWS`` rows, for jobs over short rows of numbers; the session's are for texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(WORD_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def _release(table: DataFrame) -> None:
    """Let go of the shuffles behind a table that has been written; Spark deletes their files when the driver collects garbage, which it may not need to do for long."""
    table.sparkSession._jvm.System.gc()


def _hashes(data: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _ascending(keys: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit keys.  Numbers sort much faster than they are ranked, so places stand in for low bits of the keys, which are put right afterwards."""
    low = np.uint64(max(len(keys) - 1, 1).bit_length())
    mask = (np.uint64(1) << low) - np.uint64(1)
    order = keys & ~mask
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= mask
    order = order.view(np.int64)
    got = keys[order]
    if (got[1:] < got[:-1]).any():
        order = order[np.argsort(got, kind="stable")]
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, where each one stands first, and each key's number among them."""
    order = _ascending(keys)
    got = keys[order]
    fresh = np.r_[np.ones(min(len(got), 1), bool), got[1:] != got[:-1]]
    key, first = got[fresh], order[fresh]
    del got
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return key, first, at


def pair_hashes(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of each pair of word hashes."""
    return _scramble(_mixed(context.view(np.uint64)) + word.view(np.uint64))


def _pairs_of(row: dict, tokens: np.ndarray | None = None, blocks: int = RANGES) -> Iterator[tuple[np.ndarray, ...]]:
    """A chunk's pairs by ranges of their hashes, ascending, so that one range at a time is sorted: the hashes, sorted, the
    pairs' contexts, words and training counts, and the places of the range's tokens and the pair of each.  No range cuts a block."""
    words, lengths = _hashes(row["words"]), np.array(row["lengths"], np.int64)
    tokens = _unpacked(row["tokens"], np.int32) if tokens is None else tokens
    opening, start = np.zeros(len(tokens), bool), np.flatnonzero(words == START)[0].astype(np.int32)
    opening[np.cumsum(lengths) - lengths] = True
    learnt = np.repeat(~np.array(row["held"], bool), lengths)
    words, part = words.view(np.uint64), np.empty(len(tokens), np.uint8)
    mixed = _mixed(words)

    def before(place: np.ndarray) -> np.ndarray:
        return np.where(opening[place], start, tokens[place - 1])

    def hashes(place: np.ndarray) -> np.ndarray:
        out = mixed[before(place)]
        out += words[tokens[place]]
        return _scramble(out)
    for a in range(0, len(tokens), SCORED):
        place = np.arange(a, min(a + SCORED, len(tokens)))
        part[place] = _block_of(hashes(place), blocks) * RANGES // blocks
    for k in range(RANGES):
        place = np.flatnonzero(part == k)
        if len(place):
            key, first, at = _distinct(hashes(place))
            first = place[first]
            yield key, before(first), tokens[first], np.bincount(at[learnt[place]], minlength=len(key)), place, at


def _told(rows: Iterator[pa.Scalar], n: int) -> np.ndarray:
    """What the next rows tell of ``n`` pairs."""
    parts = []
    while n > 0:
        parts.append(_unpacked(next(rows).as_buffer(), np.uint32))
        n -= len(parts[-1])
    return np.concatenate(parts)


def _pair_counts(row: dict) -> Iterator[pa.RecordBatch]:
    words = _hashes(row["words"])
    for _, context, word, n, _, _ in _pairs_of(row):
        yield pa.record_batch([pa.array(words[context]), pa.array(words[word]), pa.array(n)], ["context", "word", "n"])


def _sorted_packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences; only the three high bytes of these are worth compressing."""
    flat = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return flat[:5].tobytes() + zlib.compress(flat[5:].tobytes(), 1)


def _sorted_unpacked(data: bytes, n: int) -> np.ndarray:
    flat = np.concatenate([np.frombuffer(data, np.uint8, 5 * n), np.frombuffer(zlib.decompress(data[5 * n:]), np.uint8)])
    return np.cumsum(flat.reshape(8, n).T.copy().view("<u8").reshape(-1), dtype=np.uint64)


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of pair hashes, ranges of their high 32 bits."""
    return (((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _parts(chunk: int, key: np.ndarray, n: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Ascending keys of a chunk and their counts, by block."""
    ends = np.searchsorted(_block_of(key, blocks), np.arange(blocks + 1))
    some = np.flatnonzero(np.diff(ends))
    parts = [slice(ends[k], ends[k + 1]) for k in some]
    return pa.record_batch([pa.array(some), pa.array(np.full(len(some), chunk)), pa.array(np.diff(ends)[some]),
                            pa.array([_sorted_packed(key[x]) for x in parts], pa.binary()), pa.array([_packed(n[x]) for x in parts], pa.binary())],
                           ["block", "chunk", "size", "keys", "counts"])


_PARTS = "block long, chunk long, size long, keys binary, counts binary"


def blocked(chunked: DataFrame, blocks: int) -> DataFrame:
    """(block, chunk, size, keys, counts): the pairs of a chunk in a block and their training counts."""
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        for key, _, _, n, _, _ in _pairs_of(row, blocks=blocks):
            yield _parts(row["chunk"], key, n, blocks)
    return _each(chunked.select("chunk", "held", "lengths", "tokens", "words"), work, _PARTS, 100)


def blocked_words(chunked: DataFrame, blocks: int) -> DataFrame:
    """The same of the words of a chunk."""
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        words = _hashes(row["words"]).view(np.uint64)
        order = _ascending(words)
        yield _parts(row["chunk"], words[order], _unpacked(row["counts"])[order], blocks)
    return _each(chunked.select("chunk", "words", "counts"), work, _PARTS, 100)


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block, their totals, each entry's key, and where the entries of a row end."""
    sizes = rows["size"].to_numpy()
    keys = np.concatenate([_sorted_unpacked(x.as_py(), n) for x, n in zip(rows["keys"], sizes.tolist())])
    counts = np.concatenate([_unpacked(x.as_py()) for x in rows["counts"]])
    key, _, at = _distinct(keys)
    return key, np.bincount(at, counts, len(key)).astype(np.int64), at, np.cumsum(sizes)


def _known_words(rows: pa.Table) -> pa.Table:
    """A row without a chunk with the training words of a block and their totals, and for each chunk the links of its words to these."""
    word, total, at, ends = _summed(rows)
    known = total > 0
    links = np.where(known, 1 + np.cumsum(known), 0)[at]
    links = [*(_links_packed(x) for x in np.split(links, ends[:-1])), None]
    own = [None] * rows.num_rows
    return pa.table([pa.array([*rows["block"].to_pylist(), rows["block"][0].as_py()], pa.int64()), pa.array([*rows["chunk"].to_pylist(), None], pa.int64()), pa.array([*own, word[known].tobytes()], pa.binary()),
                     pa.array([*own, total[known].tobytes()], pa.binary()), pa.array(links, pa.binary())], ["block", "chunk", "words", "counts", "links"])


def _word_counts(row: dict) -> Iterator[pa.RecordBatch]:
    yield pa.record_batch([pa.array(_hashes(row["words"])), pa.array(_hashes(row["counts"]))], ["word", "n"])


def _totals(rows: pa.Table) -> pa.Table:
    """For each chunk of a block the totals above one of its pairs, of which one chunk only is told, and all its links."""
    pair, total, at, ends = _summed(rows)
    first = np.zeros(len(pair), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    told = np.zeros(len(at), np.int64)
    told[first] = np.where(total > 1, total, 0)
    links = np.where(total > 1, 1 + np.cumsum(total > 1), total)[at]
    told, links = (pa.array([f(x) for x in np.split(values, ends[:-1])], pa.binary()) for f, values in ((_packed, told), (_links_packed, links)))
    return pa.table([rows["block"], rows["chunk"], told, links], ["block", "chunk", "totals", "links"])


def _links_packed(links: np.ndarray) -> bytes:
    """0 for a pair without customers, 1 for one with a single one, else 2 and the place among the block's others, ascending; places by their differences."""
    out, many = links.copy(), links > 1
    out[many] = np.diff(links[many], prepend=1) + 1
    return _packed(out)


def _links_unpacked(data: bytes) -> np.ndarray:
    out = _unpacked(data)
    many = out > 1
    out[many] = 1 + np.cumsum(out[many] - 1)
    return out


def _repeated(chunk: pa.Table, totals: pa.Table, blocks: int) -> pa.Table:
    """The pairs that a chunk has been told of, with one table each."""
    out = []
    order = np.argsort(totals["block"].to_numpy()).tolist()
    for k in range(chunk.num_rows):
        row = {c: chunk[c][k].as_py() for c in chunk.schema.names}
        words, told = _hashes(row["words"]), map(totals["totals"].__getitem__, order)
        for key, context, word, *_ in _pairs_of(row, blocks=blocks):
            n = _told(told, len(key)).astype(np.int64)
            some = n > 0
            out.append(pa.table([pa.array(x) for x in (words[word[some]], words[context[some]], n[some], np.ones(some.sum(), np.int64))], ["word", "context", "n", "t0"]))
    return pa.concat_tables(out)


def log_stirling(most: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), c and t up to ``most``."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + s[c]
            s[c + 1] = np.logaddexp(np.r_[-np.inf, s[c, :-1]], stay)
    return s


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    return _scramble(x.copy())


def _scramble(x: np.ndarray) -> np.ndarray:
    """The same, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Draws:
    """Random numbers of rows, by the rows' keys and the step alone."""

    def __init__(self, step: int, *keys: np.ndarray):
        self.key = np.full(len(keys[0]), (SEED << 32) + step, np.uint64)
        for k in keys:
            self.key = _scramble(self.key + k.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    def of(self, rows: np.ndarray) -> Draws:
        out = Draws.__new__(Draws)
        out.key = self.key[rows]
        return out

    def uniform(self, nth: int, n: int) -> np.ndarray:
        """The nth number, above 0 and below 1, of the first n rows."""
        return ((_scramble(self.key[:n] + np.uint64((nth * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)) + 0.5) * 2.0 ** -52

    def poisson(self, nth: int, mean: np.ndarray) -> np.ndarray:
        """Poisson numbers by inversion, from a mean of 30 on by the normal law."""
        n = len(mean)
        u = self.uniform(2 * nth, n)
        out = np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * self.uniform(2 * nth + 1, n)))
        small = np.flatnonzero(mean < 30)
        chance, left, k = np.exp(-mean[small]), u[small].copy(), 0
        out[small] = 0
        while len(small):
            left -= chance
            on = (left > 0) & (k < 200)
            small, left, k = small[on], left[on], k + 1
            chance = chance[on] * mean[small] / k
            out[small] = k
        return np.maximum(out, 0).astype(np.int64)


def tables(c: np.ndarray, p: np.ndarray, d: float, others: np.ndarray, stirling: np.ndarray, draw: Draws) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers and parent probability ``p``, beside ``others`` tables in the restaurant."""
    out = np.minimum(c, 1)
    rows = np.flatnonzero(c > 1)
    if not len(rows):
        return out
    rows = rows[np.argsort(-c[rows], kind="stable")]
    draw = draw.of(rows)
    most = np.minimum(c[rows], EXACT)
    log_p, rest = np.log(p[rows]), np.maximum(others[rows], 0)
    best, pick, law = np.full(len(rows), -np.inf), np.ones(len(rows), np.int64), np.zeros(len(rows))
    for t in range(1, int(most[0]) + 1):
        n = int(np.searchsorted(-most, -t, "right"))
        law[:n] += np.log(STRENGTH + d * (rest[:n] + t - 1)) + log_p[:n]
        value = law[:n] + stirling[most[:n], t] - np.log(-np.log(draw.uniform(t, n)))
        better = value > best[:n]
        best[:n][better], pick[:n][better] = value[better], t
    many = int(np.searchsorted(-c[rows], -EXACT, "left"))
    if many:  # more customers arrive in blocks
        total, seated, t, turn = c[rows[:many]], np.full(many, EXACT), pick[:many], EXACT
        while (seated < total).any():
            turn += 1
            block = np.minimum(np.maximum(seated // 20, 1), total - seated)
            fresh = (STRENGTH + d * (rest[:many] + t)) * p[rows[:many]]
            t = t + np.minimum(draw.poisson(turn, block * fresh / (fresh + seated - d * t)), block)
            seated = seated + block
        pick[:many] = t
    out[rows] = pick
    return out


@dataclass
class Totals:
    """What sweeps need beyond a word's own row."""

    vocabulary: int
    parent_customers: float
    parent_tables: float
    discount: float
    parent_discount: float


def _numbered(name: str, n: int) -> list[str]:
    return [f"{name}{k}" for k in range(n)]


def _sweeps(frame: DataFrame, totals: Totals, job: int, sweeps: int) -> DataFrame:
    """Rows (word, context, n, t0, t1, ...) of pairs after ``sweeps`` sweeps; ``c``, ``root_t`` and ``seated`` are the totals of the word and the context."""
    below, base = log_stirling(EXACT, totals.discount), 1.0 / (totals.vocabulary + 1)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, context, n, t, c, root_t, seated = (batch.column(x).to_numpy().astype(np.int64) for x in ("word", "context", "n", "t", "c", "root_t", "seated"))
        rest, others, draws = c - t, seated - t, []
        p = ((rest - totals.parent_discount * np.minimum(root_t, rest)) + (STRENGTH + totals.parent_discount * totals.parent_tables) * base) / (STRENGTH + np.maximum(totals.parent_customers - t, 0))
        for k in range(sweeps):
            draws.append(tables(n, p, totals.discount, others, below, Draws(job << 8 | k, word, context)))
        return pa.record_batch([batch.column("word"), batch.column("context"), batch.column("n"), *map(pa.array, draws)], ["word", "context", "n", *_numbered("t", sweeps)])
    return _in_runs(frame, work, ", ".join(f"{c} long" for c in ("word", "context", "n", *_numbered("t", sweeps))))


def _drawn(sweeps: int) -> Column:
    """Tables of a pair, summed over the sweeps."""
    return sum((F.col(c) for c in _numbered("t", sweeps)[1:]), F.col("t0"))


def _seated(words: DataFrame, state: DataFrame, sweeps: int) -> DataFrame:
    """(word, n, root_t, busy, c0, c1, ..., seated, mean): a word's tables in all restaurants after each sweep, and those in its own restaurant, last and on average.

    Pairs that are not in ``state`` have one customer and one table.
    """
    none, n, parents = F.lit(0).cast("long"), F.col("n"), _numbered("c", sweeps)
    both = state.select("word", *((F.col(t) - n).alias(c) for t, c in zip(_numbered("t", sweeps), parents)), none.alias("seated"), none.alias("total")).unionByName(
        state.select(F.col("context").alias("word"), *(none.alias(c) for c in parents), (F.col(f"t{sweeps - 1}") - n).alias("seated"), (_drawn(sweeps) - sweeps * n).alias("total")))
    sums = both.groupBy("word").agg(*(F.sum(c).alias(c) for c in [*parents, "seated", "total"]))
    add = lambda c: n + F.coalesce(F.col(c), none)
    return words.select("word", "n", "root_t").join(sums, "word", "left").select(
        "word", "n", "root_t", F.col("total").isNotNull().alias("busy"), *(add(c).alias(c) for c in parents),
        add("seated").alias("seated"), (n + F.coalesce(F.col("total"), none) / sweeps).alias("mean"))


def _rooted(frame: DataFrame, totals: Totals, job: int, sweeps: int) -> DataFrame:
    """The same with r0, r1, ...: each sweep's tables in the parent."""
    above, base = log_stirling(EXACT, totals.parent_discount), 1.0 / (totals.vocabulary + 1)
    kept, roots = ["word", "n", "busy", *_numbered("c", sweeps), "seated", "mean"], _numbered("r", sweeps)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, root_t, drawn = batch.column("word").to_numpy(), batch.column("root_t").to_numpy().astype(np.int64), []
        for k in range(sweeps):
            root_t = tables(batch.column(f"c{k}").to_numpy().astype(np.int64), np.full(len(word), base), totals.parent_discount, totals.parent_tables - root_t, above, Draws(1 << 16 | job << 8 | k, word))
            drawn.append(pa.array(root_t))
        return pa.record_batch([*(batch.column(c) for c in kept), drawn[-1], *drawn], [*kept, "root_t", *roots])
    return _in_runs(frame, work, ", ".join(f"{c} {dict(busy='boolean', mean='double').get(c, 'long')}" for c in (*kept, "root_t", *roots)))


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


@dataclass
class Model:
    """Rows of words (word, n, p, mean), rows of pairs, and the numbers that all words share."""

    dishes: DataFrame
    state: DataFrame  # pairs with two training tokens or more: word, context, n, t0, t1, ...
    blocks: int  # ranges of pair hashes
    links: DataFrame  # block, chunk and what each of its pairs there is in ``state``
    word_blocks: int  # ranges of word hashes
    word_links: DataFrame  # block, chunk and which of ``dishes`` each of its words there is; rows without a chunk hold these
    pairs: DataFrame  # all pairs of all chunks, not yet counted
    tokens: int
    vocabulary: int
    discount: float
    unknown: float

    def owned(self) -> DataFrame:
        """(word, context, own) of the pairs in ``state``: customers less discounts."""
        return self.state.select("word", "context", (F.col("n") - self.discount * (_drawn(SAMPLES) / SAMPLES)).alias("own"))

    # Below, a small model as a whole on the driver, to look at: context 0 is a word not seen before, 1 the start, others as in ``named``.
    @cached_property
    def _known(self) -> dict:
        return {r["word"]: r for r in self.dishes.collect()}

    @cached_property
    def named(self) -> np.ndarray:
        return np.array(sorted(w for w in self._known if w != START), np.int64)

    @cached_property
    def customers(self) -> np.ndarray:
        return np.array([0, *(self._known[w]["n"] if w in self._known else 0 for w in (START, *self.named))])

    @cached_property
    def tables(self) -> np.ndarray:
        return np.array([0, *(self._known[w]["mean"] if w in self._known else 0 for w in (START, *self.named))])

    @cached_property
    def words(self) -> DataFrame:
        """(word, n, p, own) with the entries of ``own_counts``."""
        every = self.pairs.groupBy("word", "context").agg(F.sum("n").alias("n")).where("n > 0")
        number = {START: 1} | {int(w): i + 2 for i, w in enumerate(self.named)}
        own = {w: [] for w in self._known}
        for r in every.join(self.owned(), ["word", "context"], "left").collect():
            own[r["word"]].append((number[r["context"]], r["n"] - self.discount if r["own"] is None else r["own"]))
        return self.dishes.sparkSession.createDataFrame([(w, r["n"], r["p"], bytearray(np.array(own[w], _OWN).tobytes())) for w, r in self._known.items()],
                                                        "word long, n long, p double, own binary")


def fit(chunked: DataFrame) -> Model:
    """Count, seat, sample and average over the training documents of all chunks."""
    spark = chunked.sparkSession
    read = chunked.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    blocks, word_blocks = 1 + read // BLOCK, 1 + read // WORD_BLOCK
    spelt = cut(blocked_words(chunked, word_blocks).groupBy("block").applyInArrow(_known_words, "block long, chunk long, words binary, counts binary, links binary"))
    counted = cut(_each(spelt.where("chunk is null").select("words", "counts"), _word_counts, "word long, n long"))
    tokens, vocabulary = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    pairs = _each(chunked.select("held", "lengths", "tokens", "words"), _pair_counts, "context long, word long, n long")
    linked = cut(blocked(chunked, blocks).groupBy("block").applyInArrow(_totals, "block long, chunk long, totals binary, links binary"))
    _release(linked)
    state = cut(chunked.select("chunk", "held", "lengths", "tokens", "words").groupBy("chunk").cogroup(linked.select("block", "chunk", "totals").groupBy("chunk")).applyInArrow(lambda chunk, totals: _repeated(chunk, totals, blocks), "word long, context long, n long, t0 long"))
    held, twos = state.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") == 2, 1))).first()
    discount = _discount(tokens - held, twos)  # what is in no row of the state are single customers
    words = cut(_seated(counted.withColumn("root_t", F.lit(1).cast("long")), state, 1))
    customers = words.agg(F.coalesce(F.sum("c0"), F.lit(0))).first()[0]
    totals, last = Totals(vocabulary, float(customers), float(vocabulary), discount, 0.5), 1
    means = None
    for job, sweeps in enumerate((1, BURN, SAMPLES)):
        busy = words.where("busy")
        rows = state.select("word", "context", "n", F.col(f"t{last - 1}").alias("t")).join(busy.select(F.col("word").alias("context"), "seated"), "context")
        rows = rows.join(busy.select("word", F.col(f"c{last - 1}").alias("c"), "root_t"), "word")
        before = state
        with _wide_batches(spark):
            state = cut(_sweeps(rows, totals, job, sweeps))
        discard(before)
        with _wide_batches(spark):
            words, old, last = cut(_rooted(_seated(words, state, sweeps), totals, job, sweeps)), words, sweeps
        discard(old)
        _release(words)
        sums = words.agg(*(F.sum(c) for c in (*_numbered("c", sweeps), *_numbered("r", sweeps))), *(F.count(F.when(F.col(f"c{sweeps - 1}") == one, 1)) for one in (1, 2))).first()
        sums = [float(x or 0) for x in sums]
        means = (sums[:sweeps], sums[sweeps:2 * sweeps])
        parent_discount = totals.parent_discount if job else _discount(int(sums[-2]), int(sums[-1]))
        totals = Totals(vocabulary, means[0][-1], means[1][-1], discount, parent_discount)
    discard(counted)
    d0, base = totals.parent_discount, 1.0 / (vocabulary + 1)
    spare = [(STRENGTH + d0 * t) / (STRENGTH + c) * base for c, t in zip(*means)]
    p = sum(((F.col(f"c{k}") - d0 * F.col(f"r{k}")) / (STRENGTH + means[0][k]) + spare[k]) for k in range(SAMPLES)) / SAMPLES
    return Model(words.select("word", "n", p.alias("p"), "mean"), state, blocks, linked, word_blocks, spelt, pairs, int(tokens), int(vocabulary), discount, float(np.mean(spare)))


def scored(chunked: DataFrame, model: Model) -> DataFrame:
    """Scores of all documents of the chunks, which are those that the model was fitted on."""
    tokens, vocabulary, unknown, discount, blocks = model.tokens, model.vocabulary, model.unknown, model.discount, model.blocks
    answer = "chunk long, place int, n binary, p binary, mean binary, seats binary, counts binary"
    names = [x.split()[0] for x in answer.split(", ")]

    def described(rows: pa.Table, dishes: pa.Table) -> pa.Table:
        order = np.argsort(dishes["word"].to_numpy().view(np.uint64))
        n, p, mean = (np.r_[none, none, dishes[c].to_numpy()[order]] for c, none in (("n", 0), ("p", unknown), ("mean", 0.0)))
        links = [_links_unpacked(x.as_py()) for x in rows["links"]]
        parts = [pa.array([f(x) for x in links], pa.binary()) for f in (lambda x: _packed(n[x]), lambda x: p[x].tobytes(), lambda x: mean[x].tobytes())]
        return pa.table([rows["chunk"], rows["block"].cast(pa.int32()), *parts, *[pa.nulls(rows.num_rows, pa.binary())] * 2], names)
    block = F.shiftright(F.shiftrightunsigned("word", 32) * F.lit(model.word_blocks).cast("long"), 32).alias("block")
    told = model.word_links.where("chunk is not null").select("block", "chunk", "links").groupBy("block").cogroup(model.dishes.select(block, "*").groupBy("block")).applyInArrow(described, answer)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = pair_hashes(*(batch.column(c).to_numpy() for c in ("context", "word")))
        return pa.record_batch([pa.array(_block_of(key, blocks)), pa.array(key.view(np.int64)), batch.column("n"), batch.column("seats")], ["block", "pair", "n", "seats"])
    seats = _in_runs(model.state.select("word", "context", "n", _drawn(SAMPLES).alias("seats")), dealt, "block long, pair long, n long, seats long")

    def answered(rows: pa.Table, seated: pa.Table) -> pa.Table:
        order = np.argsort(seated["pair"].to_numpy().view(np.uint64))
        seats, count = (np.r_[0, one, seated[c].to_numpy()[order]] for c, one in (("seats", SAMPLES), ("n", 1)))  # one customer has one table
        links = [_links_unpacked(x.as_py()) for x in rows["links"]]
        parts = [pa.array([_packed(values[x]) for x in links], pa.binary()) for values in (seats, count)]
        return pa.table([rows["chunk"], pa.array((-1 - rows["block"].to_numpy()).astype(np.int32)), *[pa.nulls(rows.num_rows, pa.binary())] * 3, *parts], names)
    with _wide_batches(chunked.sparkSession):
        told = cut(told.unionByName(model.links.select("block", "chunk", "links").groupBy("block").cogroup(seats.groupBy("block")).applyInArrow(answered, answer)))
    _release(told)
    kind = chunked.schema["doc_ids"].dataType.elementType.simpleString()
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        place = told["place"].to_numpy()
        order, dealt = np.argsort(place).tolist(), int((place < 0).sum())
        pairs_told, words_told = order[:dealt][::-1], order[dealt:]  # places of blocks of pairs are negative, -1 the first
        for k in range(texts.num_rows):
            words, flat, lengths = _hashes(texts["words"][k].as_buffer()), _unpacked(texts["tokens"][k].as_buffer(), np.int32), texts["lengths"][k].values.to_numpy().astype(np.int64)
            n, p, mean = np.zeros((3, len(words)))
            order = _ascending(words.view(np.uint64))
            n[order], p[order], mean[order] = (np.concatenate([f(told[c][i].as_buffer()) for i in words_told]) for c, f in (("n", _unpacked), ("p", np.frombuffer), ("mean", np.frombuffer)))
            room, spare = STRENGTH + n, STRENGTH + discount * mean
            chance, (seats, counts) = np.empty(len(flat)), (map(told[c].__getitem__, pairs_told) for c in ("seats", "counts"))
            for key, context, word, _, place, at in _pairs_of({"words": texts["words"][k].as_buffer(), "lengths": lengths, "held": texts["held"][k].as_py()}, flat, blocks):
                own = _told(seats, len(key)) / SAMPLES
                own *= discount
                np.subtract(_told(counts, len(key)), own, out=own)
                chance[place] = np.log10((spare[context] * p[word] + own) / room[context])[at]
            base = np.log10((n + 1) / (tokens + vocabulary + 1))
            ends = np.cumsum(lengths)
            sums = np.zeros((3, len(lengths)))
            a = 0
            while a < len(lengths):  # whole documents, about SCORED tokens at once
                start = ends[a] - lengths[a]
                b = max(a + 1, int(np.searchsorted(ends, start + SCORED, "right")))
                part, first = flat[start:ends[b - 1]], (ends - lengths)[a:b] - start
                for row, x in zip(sums, ((n > 0)[part], base[part], chance[start:ends[b - 1]])):
                    row[a:b] = np.add.reduceat(x.astype(float), first)
                a = b
            out.append(pa.table([texts["doc_ids"][k].values, pa.array(texts["held"][k].as_py()), pa.array(lengths), pa.array(sums[0].astype(np.int64)),
                                 pa.array(np.full(len(lengths), tokens)), pa.array(sums[1]), pa.array(sums[2])], columns))
        schema = pa.schema([("doc_id", texts.schema.field("doc_ids").type.value_type), ("held_out", pa.bool_()), *((c, pa.int64()) for c in columns[2:5]), *((c, pa.float64()) for c in columns[5:])])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.select("chunk", "doc_ids", "held", "lengths", "tokens", "words").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(work, schema)


def query(docs: DataFrame) -> DataFrame:
    chunked = cut(chunks(docs))
    model = fit(chunked)
    out = scored(chunked, model)
    for table in (model.state, model.links, model.word_links):
        discard(table)
    return out
