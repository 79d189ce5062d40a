"""Best-fit packing of token sequences by swap-based local search.

A document is its token ids and a final id 0; only longer ones are cut, into pieces of
``SIZE`` tokens.  Pieces are dealt at random into shards of about ``SHARD`` pieces, which
are packed apart: best fit of the longest first, then local search among the bins that
are not full.  Working on the emptiest bins, a piece moves to another bin, is exchanged
for a shorter one, for two shorter ones, or two are exchanged for one longer in sum less
the gap; every step raises the sum of squared fills, so it ends, and bins that become
empty go.  A shard stops at its lower bound, the tokens divided by ``SIZE``, when no step
is left, or ``PATIENCE`` steps after the last bin became empty.  A shard
wastes less than a bin as a rule, so the loss is about one in ``SHARD`` pieces.

Tokens come from a public vocabulary file, whose path is a parameter.  Its rules never
join characters across a space or a line feed, so runs between them are encoded once and
remembered.  Null and empty texts are the single id 0.  Repeated rows are packed each;
only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut, texts_of

SIZE, SHARD, VOCABULARY = 2048, 8192, "word_bpe_49k.json"
#: Steps that the local search of a shard takes without emptying a bin before it ends.
PATIENCE = 30
#: Runs and words that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
_END = b"\0\0\0\0"
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LETTERS = re.compile(f"[{_LATIN}]+")
#: Without apostrophes and angle brackets, which begin endings and special tokens.
_MARKS = re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")
_PLAIN = re.compile(f"[{_LATIN}0-9{_MARKS}]+")
_PART = re.compile(f"[{_LATIN}]+|[0-9]|[{_MARKS}]+")
#: The vocabulary shows bytes as characters: printable ones as themselves, the others in order from 256 on.
_BARE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip(sorted(set(range(256)).difference(_BARE)), range(256, 512)))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Runs(dict):
    """Token ids of runs between spaces, as little-endian 32-bit words; a new run is encoded when first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self[""] = b""
        self.marks = {m: self._whole(m) for m in ".,"}

    def _whole(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        """Plain runs are letters, digits and marks, which never merge with each other; others take the whole way."""
        mark = self.marks.get(run[-1], b"")
        body = run[:-1] if mark else run
        ids = self.words.get(body)
        if ids is None:
            if body.isascii() and body.isalpha():
                ids = self.words[body] = array("I", [t.id for t in self.merge(body.lower())]).tobytes()
            elif _LETTERS.fullmatch(body):
                ids = self.words[body] = array("I", [t.id for t in self.merge(body.lower().encode().decode("latin-1").translate(_SHOWN))]).tobytes()
            elif _PLAIN.fullmatch(run):
                parts, mark = _PART.findall(run), b""
                ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self._whole(run)
            else:
                ids, mark = self._whole(run), b""
        self[run] = ids = ids + mark
        return ids


class Encoder:
    """Token ids of whole texts."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.runs = Runs(path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per Python worker."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
            self.runs[""] = b""
        if len(self.runs.words) > REMEMBERED:
            self.runs.words.clear()
        get = self.runs.__getitem__
        return [b"".join(map(get, text.replace("\n", " ").split(" "))) for text in texts]


def pieces(docs: DataFrame, path: str, size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document and its ``keep`` columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, nth, length, crc, held = [], [], [], [], []
        for i, ids in enumerate(Encoder.of(path).encode(texts_of(batch))):
            ids += _END
            held.append(ids)
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at:at + 4 * size]
                row.append(i), nth.append(k), length.append(len(part) // 4), crc.append(zlib.crc32(part))
        ends = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
        tokens = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(held), "<i4")))
        return pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(nth, pa.int32()), pa.array([k * size for k in nth], pa.int64()),
                                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), tokens, *(batch.column(c).take(pa.array(row)) for c in keep)],
                               ["doc_id", "piece", "start", "length", "ids_crc32", "ids", *keep])
    return arrow_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep), work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>{kept}")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of row numbers: longest first, each into the bin with the least room that fits."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            b, room = len(bins), size
            bins.append([i])
        left = room - n
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


class Search:
    """Local search among bins that are not full."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.full = [b for b in bins if lengths[b].sum() >= size]
        self.open = [b for b in bins if lengths[b].sum() < size]

    def run(self) -> list[list[int]]:
        least = -(-sum(int(self.lengths[b].sum()) for b in self.open) // self.size)
        stuck = steps = 0
        self.open.sort(key=lambda b: int(self.lengths[b].sum()))
        while len(self.open) > least and stuck < len(self.open) and steps < PATIENCE:
            steps += 1
            if self._step(stuck):
                stuck = 0
                steps *= all(self.open)
                self.full += [b for b in self.open if self.lengths[b].sum() >= self.size]
                self.open = sorted((b for b in self.open if b and self.lengths[b].sum() < self.size), key=lambda b: int(self.lengths[b].sum()))
                least = -(-sum(int(self.lengths[b].sum()) for b in self.open) // self.size)
            else:
                stuck += 1
        return self.full + self.open

    def _step(self, at: int) -> bool:
        """Give content of bin ``at`` to a fuller one, by the step that raises its fill most."""
        source = self.open[at]
        targets = self.open[at + 1:]
        if not targets:
            return False
        docs = np.concatenate([np.array(b) for b in targets])
        owner = np.repeat(np.arange(len(targets)), [len(b) for b in targets])
        n = self.lengths[docs]
        fill = np.bincount(owner, n, len(targets)).astype(np.int64)
        room = self.size - fill
        order = np.lexsort((n, owner))
        docs, owner, n = docs[order], owner[order], n[order]
        best = (0, None)
        sizes = {}
        for i in source:
            sizes.setdefault(int(self.lengths[i]), i)
        for a, i in sizes.items():  # move
            fits = np.flatnonzero(room >= a)
            if len(fits) and a > best[0]:
                best = (a, ([i], [], int(fits[room[fits].argmin()])))
        give = [(a, (i,)) for a, i in sizes.items()]
        give += [(int(self.lengths[i] + self.lengths[j]), (i, j)) for i, j in self._couples(source)]
        sums, which = np.unique([a for a, _ in give], return_index=True)
        at_most = np.searchsorted(sums, n + room[owner], "right") - 1  # one or two for one
        gain = np.where(at_most >= 0, sums[at_most] - n, 0)
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (int(gain[k]), (list(give[which[at_most[k]]][1]), [int(docs[k])], int(owner[k])))
        key = owner * (2 * self.size + 2) + n  # one for two: the longest partner in the same bin
        for a, i in sizes.items():
            other = np.searchsorted(key, owner * (2 * self.size + 2) + (a - 1 - n), "right") - 1
            rows = np.arange(len(n))
            fit = (a - 1 - n > 0) & (other >= 0) & (owner[other] == owner) & (other < rows)
            two = np.where(fit, n + n[other], 0)
            gain = np.where(fit & (a - two <= room[owner]), a - two, 0)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (int(gain[k]), ([i], [int(docs[k]), int(docs[other[k]])], int(owner[k])))
        if best[1] is None:
            return False
        given, taken, b = best[1]
        target = targets[b]
        for i in given:
            source.remove(i)
            target.append(i)
        for i in taken:
            target.remove(i)
            source.append(i)
        return True

    def _couples(self, source: list[int]):
        """Pairs of pieces of a bin, one for each pair of lengths."""
        seen: dict[int, list[int]] = {}
        for i in source:
            held = seen.setdefault(int(self.lengths[i]), [])
            if len(held) < 2:
                held.append(i)
        yield from ((v[0], v[1]) for v in seen.values() if len(v) > 1)
        yield from ((x[0], y[0]) for x, y in combinations(seen.values(), 2))


def pack(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0 without gaps."""
    found = Search(best_fit(lengths, size), lengths, size).run()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, rows in enumerate(found):
        where[rows] = k
        offset[rows] = np.cumsum(np.r_[0, lengths[rows][:-1]])
    return where, offset


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, shard: int = SHARD, apart: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece; ``ids`` are its tokens.

    Only lengths are packed; their places are joined back to the written pieces.  With
    ``apart``, a column of few values that is returned too, a sequence holds documents of one value.
    """
    ready = cut(pieces(docs, path or vocabulary_path(), size, (apart,) if apart else ()).withColumn("nth", F.monotonically_increasing_id()))
    drawn = F.xxhash64("nth")
    if apart:
        found = ready.groupBy(apart).count().collect()
        shards = [max(1, -(-r["count"] // shard)) for r in found]
        number = F.lit(None).cast("long")  # each value has shard numbers of its own
        for r, n, first in zip(found, shards, np.cumsum([0, *shards]).tolist()):
            number = F.when(F.col(apart).eqNullSafe(F.lit(r[apart])), F.pmod(drawn, F.lit(n)) + first).otherwise(number)
    else:
        number = F.pmod(drawn, F.lit(max(1, -(-ready.count() // shard))))
    dealt = ready.select("nth", "length", number.alias("shard"))

    def work(part: pa.Table) -> pa.Table:
        where, offset = pack(part.column("length").to_numpy(), size)
        ids = part.column("shard").to_numpy() * (1 << 32) + where
        return pa.table([part.column("nth"), pa.array(ids), pa.array(offset)], names=["nth", "sequence_id", "offset"])
    places = dealt.groupBy("shard").applyInArrow(work, "nth long, sequence_id long, offset long")
    return ready.join(places, "nth").drop("nth")


def query(docs: DataFrame) -> DataFrame:
    """The packing with each piece's checksum for its ids."""
    return packed(docs).drop("ids")
