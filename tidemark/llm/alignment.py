"""Alignment of two tokenizers' tokens by galloping intersection of their end offsets.

Tokenizer A is a byte-level vocabulary that reads a space and the text, B a piece vocabulary
that adds the space itself; both spell the same bytes.  A place where tokens of both end is
common.  Common places are found from the shorter list of ends: for each of them a step is
doubled through the longer one until it is passed, then bisected; their indices cut both
lists into groups, and differences of indices are the groups' ranges of tokens.  Every token
of A in a group is linked with every token of B in it.

Neither vocabulary joins characters across a single space between two characters that are
not white space: A's pattern begins a new part there and no piece of B holds a space after
another character (checked when a vocabulary is opened).  So such a space is always common
to both, texts are cut there into units, and a worker aligns a unit once and remembers it.
Where a unit's bytes differ from its text, the whole text is taken as one unit.

A link's count is the number of documents that hold it.  Documents are worked in chunks of
about ``CHUNK`` characters: a chunk keeps how often each of its documents holds each link, as
packed bytes, and how many of its documents hold each link.  Those are summed over chunks by
link; the sums go back to the chunks that ask for them, one row a chunk and link, and become
the documents' figures in there.  So nothing of the size of the corpus is broadcast or held
in one task.  A chunk is written as many rows, blocks of about ``BLOCK`` links of its documents
and of ``ASKED`` of its links, so that no row that Spark handles is large.

Null and empty texts, and texts that either vocabulary does not spell byte for byte, have no
tokens: zeros, and empty groups.  Repeated rows are documents each; only doc_id and text are
read, and a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut, slices, texts_of
from tidemark.llm.packing import _SHOWN

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk of documents, and units that a worker remembers.
CHUNK, REMEMBERED = 3_000_000, 100_000
#: Links of the documents of a block, repeated ones counted, and links of a chunk in a row.  A document counts as ``ROW`` links
#: or characters more, so that empty ones fill blocks and chunks too.
BLOCK, ASKED, ROW = 1 << 18, 4096, 64
#: Units encoded as one text.
TOGETHER = 4096
_UNITS = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s|^\s|\s\Z")
_BYTE = {chr(c): b for b, c in _SHOWN.items()}
_SPACE = "▁"


def _parts(text: str) -> list[str]:
    """A text cut at its single spaces between two characters that are not white space."""
    return _UNITS.split(text) if _WIDE.search(text) else text.split(" ")


def gallop(wanted: np.ndarray, ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in its range of rising ``ends`` that is not below it.

    A step doubles from the start of the range until it has passed the value, then the last
    stride is bisected; all values move together.  The last end of a range is never below a value.
    """
    low, high, step = start.copy(), start.copy(), 1
    behind = np.flatnonzero(ends[high] < wanted)
    while len(behind):
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(high[behind] + step, stop[behind] - 1)
        behind, step = behind[ends[high[behind]] < wanted[behind]], 2 * step
    apart = np.flatnonzero(low < high)
    while len(apart):
        middle = (low[apart] + high[apart]) // 2
        below = ends[middle] < wanted[apart]
        low[apart[below]] = middle[below] + 1
        high[apart[~below]] = middle[~below]
        apart = apart[low[apart] < high[apart]]
    return low


class Aligned:
    """Both tokenizations of some texts, one after the other, cut into groups.

    ``a_last`` and ``b_last`` mark the last token of each group.
    """

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        self.a_last, self.b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        for drives, n, at, ends, last, n2, at2, ends2, last2 in (
                (n_a <= n_b, n_a, at_a, a_ends, self.a_last, n_b, at_b, b_ends, self.b_last), (n_a > n_b, n_b, at_b, b_ends, self.b_last, n_a, at_a, a_ends, self.a_last)):
            texts = np.flatnonzero(drives & (n > 0))
            rows, owner = _ranges(at[texts], n[texts]), np.repeat(texts, n[texts])
            found = gallop(ends[rows], ends2, at2[owner], at2[owner] + n2[owner])
            same = ends2[found] == ends[rows]
            last[rows[same]] = True
            last2[found[same]] = True
        self.a_group, self.b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        self.a_held, self.b_held = np.bincount(self.a_group), np.bincount(self.b_group)
        self.n_groups = np.add.reduceat(np.r_[self.a_last, 0], at_a) * (n_a > 0) if len(n_a) else n_a

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links in order of A's tokens, ``a << 32 | b`` each, and how many every text has."""
        times = self.b_held[self.a_group]
        right = _ranges((np.cumsum(self.b_held) - self.b_held)[self.a_group], times)
        owner = np.repeat(np.repeat(np.arange(len(self.n_a)), self.n_a), times)
        return np.repeat(self.a, times) << 32 | self.b[right], np.bincount(owner, minlength=len(self.n_a))

    def codes(self) -> np.ndarray:
        """Tokens as they are written, A's of a group before B's: twice the id, one more at the end of a side, negative for B."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        ahead_b, through_a = np.cumsum(self.b_held) - self.b_held, np.cumsum(self.a_held)
        out[np.arange(len(self.a)) + ahead_b[self.a_group]] = 2 * self.a + self.a_last
        out[np.arange(len(self.b)) + through_a[self.b_group]] = -1 - (2 * self.b + self.b_last)
        return out


class Vocabularies:
    """Token ids and bytes by both tokenizers; one per Python worker and pair of files."""

    held: dict[tuple[str, str], Vocabularies] = {}

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import path
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        place = lambda name: name if os.sep in name else path(name)
        self.a = Tokenizer.from_file(place(a))
        self.a.encode_special_tokens = True
        self.a_bytes: dict[int, bytes] = {i: bytes(_BYTE.get(c, ord(c) & 255) for c in piece) for piece, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=place(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]), np.array(list(map(len, self.b_bytes)))]
        self.written = {2 * i + last: f"{i}{'|' if last else ','}" for i in self.a_bytes for last in (0, 1)}
        self.written |= {-1 - (2 * i + last): f"{i}{';' if last else ','}" for i in range(len(pieces)) for last in (0, 1)}
        self.split = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    @classmethod
    def of(cls, a: str, b: str) -> Vocabularies:
        if (a, b) not in cls.held:
            cls.held[a, b] = cls(a, b)
        return cls.held[a, b]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B for each text; none where their bytes are not a space and the text."""
        out = []
        for a, b, text in zip(self.a.encode_batch([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), texts):
            want, ids = (" " + text).encode(), a.ids
            same = text and b"".join(map(self.a_bytes.__getitem__, ids)) == want == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((ids, b) if same else ([], []))
        return out

    def aligned(self, found: list[tuple[list[int], list[int]]]) -> Aligned:
        """Tokens of texts cut into groups."""
        (a, n_a), (b, n_b) = ((np.fromiter(chain.from_iterable(x[k] for x in found), np.int64), np.array([len(x[k]) for x in found], np.int64)) for k in (0, 1))
        return Aligned(a, n_a, b, n_b, np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))

    def units(self, texts: list[str]) -> Aligned | None:
        """The same for many units at once, encoded as one text; None where that text is not spelled byte for byte.

        Units begin and end with something else than white space.
        """
        whole = " " + " ".join(texts)
        ids = [self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole[1:])]
        want = whole.encode()
        if not b"".join(map(self.a_bytes.__getitem__, ids[0])) == want == b"".join(map(self.b_bytes.__getitem__, ids[1])):
            return None
        (a, b), ends = (np.array(x, np.int64) for x in ids), np.cumsum([len(t.encode()) + 1 for t in texts])
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        last = [np.searchsorted(x, ends) for x in (a_ends, b_ends)]
        if not (np.array_equal(a_ends[last[0]], ends) and np.array_equal(b_ends[last[1]], ends)):
            return None
        return Aligned(a, np.diff(last[0], prepend=-1), b, np.diff(last[1], prepend=-1), a_ends, b_ends)


def groups(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts): both tokenizations, and the tokens before each group's end."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabularies = Vocabularies.of(a, b)
        found = vocabularies.aligned(vocabularies.tokens(texts_of(batch)))
        before = lambda last, n: (np.flatnonzero(last) + 1) - np.repeat(np.cumsum(n) - n, found.n_groups)
        lists = [(found.a, found.n_a), (found.b, found.n_b), (before(found.a_last, found.n_a), found.n_groups), (before(found.b_last, found.n_b), found.n_groups)]
        arrays = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(v, pa.int32())) for v, n in lists]
        return pa.record_batch([batch.column("doc_id"), *arrays], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])
    return arrow_rows(_read(docs), work, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


class Units:
    """Aligned units by number: tokens, groups and links of each."""

    held: dict[tuple[str, str], Units] = {}

    @classmethod
    def of_worker(cls, a: str, b: str) -> Units:
        """Those of the task; begun anew, between two chunks, when they are many."""
        units = cls.held.get((a, b))
        if units is None or len(units.text) > REMEMBERED or units.weight > 20 * CHUNK:
            units = cls.held[a, b] = cls(Vocabularies.of(a, b))
        return units

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies = vocabularies
        self.number: dict[str, int] = {}
        self.sizes = array("q")  # n_a, n_b, n_groups, n_links of every unit
        self.text: list[str] = []
        self.weight = 0
        self.ends, self.links = array("q", [0]), array("q")

    def _add(self, found: Aligned) -> range:
        """Numbers of the texts of an alignment."""
        links, n_links = found.links()
        first = len(self.text)
        self.sizes.frombytes(np.stack([found.n_a, found.n_b, found.n_groups, n_links], 1).astype(np.int64).tobytes())
        self.ends.frombytes((len(self.links) + np.cumsum(n_links)).astype(np.int64).tobytes())
        self.links.frombytes(links.tobytes())
        written = list(map(self.vocabularies.written.__getitem__, found.codes().tolist()))
        at = 0
        for end in np.cumsum(found.n_a + found.n_b).tolist():
            self.text.append("".join(written[at:end]))
            self.weight += len(self.text[-1])
            at = end
        return range(first, len(self.text))

    def _learn(self, units: list[str]) -> None:
        """Number units; those that are not spelled byte for byte get -1."""
        if len(units) == 1:
            tokens = self.vocabularies.tokens(units)
            self.number[units[0]] = self._add(self.vocabularies.aligned(tokens))[0] if tokens[0][0] else -1
        elif units:
            found = self.vocabularies.units(units)
            if found is None:
                self._learn(units[:len(units) // 2])
                self._learn(units[len(units) // 2:])
            else:
                self.number.update(zip(units, self._add(found)))

    def of(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the units of each text; none for a text without tokens."""
        split = _parts if self.vocabularies.split else lambda text: [text]
        parts = [split(text) if text else [] for text in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(parts)) if u not in self.number]
        bare = [u for u in new if self.vocabularies.split and not (u[0].isspace() or u[-1].isspace() or _SPACE in u)]
        for at in range(0, len(bare), TOGETHER):
            self._learn(bare[at:at + TOGETHER])
        for unit in new:
            if unit not in self.number:
                self._learn([unit])
        out = []
        for text, row in zip(texts, parts):
            numbers = list(map(self.number.__getitem__, row))
            if -1 in numbers:
                tokens = self.vocabularies.tokens([text])
                numbers = list(self._add(self.vocabularies.aligned(tokens))) if tokens[0][0] else []
            out.append(numbers)
        return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Chunk:
    """Documents worked together."""

    def __init__(self, units: Units):
        self.units, self.ids, self.digests, self.numbers, self.lengths, self.size = units, [], [], array("i"), [], 0

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        self.ids.append(ids)
        self.size += sum(map(len, texts)) + ROW * len(texts)
        spelled = self.units.text.__getitem__
        for numbers in self.units.of(texts):
            self.lengths.append(len(numbers))
            self.numbers.extend(numbers)
            self.digests.append(hashlib.sha256("".join(map(spelled, numbers))[:-1].encode()).hexdigest() if numbers else "")

    def rows(self, key: int, block: int, asked: int) -> Iterator[pa.RecordBatch]:
        """The chunk as rows of lists: blocks of its documents, then its links."""
        sizes, ends = np.asarray(self.units.sizes, np.int64).reshape(-1, 4), np.asarray(self.units.ends, np.int64)
        used, numbers = np.unique(np.asarray(self.numbers, np.int64), return_inverse=True)
        n_links = ends[used + 1] - ends[used]
        starts = np.cumsum(n_links) - n_links
        links, places = np.unique(np.asarray(self.units.links, np.int64)[_ranges(ends[used], n_links)], return_inverse=True)
        at, width = np.r_[0, np.cumsum(np.asarray(self.lengths, np.int64))], max(1, len(links))
        sums = []
        for k in range(4):
            ahead = np.r_[0, np.cumsum(sizes[used, k][numbers])]
            sums.append(ahead[at[1:]] - ahead[at[:-1]])
        ids, holders = pa.chunked_array(self.ids).combine_chunks(), np.zeros(len(links), np.int64)
        row = lambda **columns: pa.record_batch([pa.array([key], pa.int64()), *[columns.get(c, pa.nulls(1, k)) for c, k in zip(LISTS, _kinds(ids.type))]], ["chunk", *LISTS])
        listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        for first, end in slices((sums[3] + ROW).tolist(), block):
            units = numbers[at[first]:at[end]]
            owner = np.repeat(np.arange(end - first), np.diff(at[first:end + 1]))
            keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            ahead = np.cumsum(n_links[units])
            for x, y in pairwise([0, *(np.flatnonzero(np.diff(ahead // block)) + 1).tolist(), len(units)]):  # many if a document is longer than a block
                n = n_links[units[x:y]]
                more = _summed(np.repeat(owner[x:y], n) * width + places[_ranges(starts[units[x:y]], n)])
                keys, times = more if not len(keys) else _summed(np.concatenate([keys, more[0]]), np.concatenate([times, more[1]]))
            holders += np.bincount(keys % width, minlength=len(holders))[:len(holders)]
            own = [listed(v) for v in (ids.slice(first, end - first), *[pa.array(s[first:end]) for s in sums], pa.array(self.digests[first:end], pa.string()))]
            packed = [pa.array([_packed(v)], pa.binary()) for v in (np.diff(keys, prepend=0), times)]
            yield row(**dict(zip(LISTS, [*own, *packed, pa.array([width], pa.int64())])))
        for first in range(0, len(links), asked):
            yield row(first=pa.array([first], pa.int32()), links=listed(pa.array(links[first:first + asked])), holders=listed(pa.array(holders[first:first + asked])))


def _summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of their times; a key without times counts once."""
    if times is None:
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from zero on, compressed: bytes of each and how many, then they."""
    narrow = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    return np.array([narrow.itemsize, len(narrow)], "<i8").tobytes() + pa.compress(narrow.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size, n = np.frombuffer(data, "<i8", 2).tolist()
    return np.frombuffer(pa.decompress(data[16:], decompressed_size=size * n, codec="zstd", asbytes=True), f"<u{size}").astype(np.int64)


#: By block of documents: key, sums and digest of each, packed steps from a document's link to the next one (documents times the chunk's
#: number of links, and the link's place), packed times that it is there, and the chunk's number of links.
#: By some of the chunk's links: the place of the first, each link's key, and how many documents hold it.
LISTS = ("ids", "n_a", "n_b", "n_groups", "n_links", "digests", "steps", "times", "width", "first", "links", "holders")


def _kinds(ids: pa.DataType) -> list[pa.DataType]:
    return [*map(pa.list_, (ids, *[pa.int64()] * 4, pa.string())), pa.binary(), pa.binary(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2]


def chunks(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """The documents as chunks, many rows each: those with ids hold documents, those with links the chunk's links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [f"array<{k}>" for k in (kind, *["long"] * 4, "string")] + ["binary", "binary", "long", "int", "array<long>", "array<long>"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = TaskContext.get().partitionId() << 32, 0
        units = Units.of_worker(a, b)
        chunk = Chunk(units)
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk.add(batch.column("doc_id"), texts_of(batch))
            if chunk.size >= CHUNK:
                yield from chunk.rows(place + count, BLOCK, ASKED)
                units = Units.of_worker(a, b)
                chunk, count = Chunk(units), count + 1
        if chunk.lengths:
            yield from chunk.rows(place + count, BLOCK, ASKED)
        Units.held.clear()  # an idle worker keeps its memory
    return _read(docs).mapInArrow(work, "chunk long, " + ", ".join(f"{c} {k}" for c, k in zip(LISTS, kinds)))


def _scored(found: pa.Table, held: pa.Table) -> pa.Table:
    """The documents of a chunk with the figures of their links."""
    width = held["width"][0].as_py()
    count, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
    place, code = found["place"].to_numpy(), found["code"].to_numpy()
    count[place], best[place] = code >> 1, code & 1
    sums: list[list[np.ndarray]] = [[], []]
    for steps, times, n in zip(held["steps"].to_pylist(), held["times"].to_pylist(), map(len, held["ids"])):
        keys, times = np.cumsum(_unpacked(steps)), _unpacked(times)
        ends, place = np.searchsorted(keys, np.arange(n + 1) * width), keys % width
        for figure, out in zip((best, count), sums):
            ahead = np.r_[0, np.cumsum(figure[place] * times)]
            out.append(np.diff(ahead[ends]))
    flat = {c: pa.chunked_array([x.values for x in held[c]], held.schema.field(c).type.value_type) for c in LISTS[:6]}
    return pa.table([*[flat[c] for c in LISTS[:5]], *[pa.array(np.concatenate(s), pa.int64()) for s in sums], flat["digests"]], list(RESULT))


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def scored(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Tokens, groups and links of every document with the corpus-wide counts of its links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ready = cut(chunks(docs, a, b))
    links = ready.where("links is not null").select("chunk", "first", "links", "holders")
    counts = cut(links.select(F.explode(F.arrays_zip("links", "holders")).alias("x")).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.holders").alias("n")))
    highest = counts.groupBy(F.shiftright("link", 32).alias("a")).agg(F.max("n").alias("most"))
    codes = (counts.withColumn("a", F.shiftright("link", 32)).join(highest, "a")
             .select("link", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("code")))
    asked = links.select("chunk", "first", F.posexplode("links").alias("at", "link")).join(codes, "link")
    found = asked.select("chunk", (F.col("first") + F.col("at")).alias("place"), "code")
    held = ready.where("ids is not null").select(F.col("chunk").alias("of"), *LISTS[:9])
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in RESULT[1:7]) + ", groups_sha256 string"
    return found.groupBy("chunk").cogroup(held.groupBy("of")).applyInArrow(_scored, schema)


def query(docs: DataFrame) -> DataFrame:
    return scored(docs)
