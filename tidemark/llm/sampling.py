"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is its lattice of vocabulary pieces; a piece weighs ``ALPHA`` times the logarithm of
1 / (``OFFSET`` + rank), a character without a piece of its own is spelled by byte pieces.
As no piece holds a space after another character, the lattice falls apart before spaces
into units; units are built once a batch, all together: a trie walk gives the edges, a
backward pass the exact partition sums, hence each edge's probability given its start.

Per text an A-star search over perturbed regions gives distinct segmentations.  The
region of all segmentations has a standard Gumbel value, which its first sample takes.
What is left is split by the sample's steps: "the same before step i, another edge at i".
A region's best value is a Gumbel at the logarithm of its mass, cut off at its parent's;
the region with the largest is opened next.  So the samples come in the order of
perturbed log-probability, exactly as if every segmentation had been perturbed.  Regions
lighter than exp(-``DEEP``) are not drawn; together they would win once in 10^12 texts.
The inclusion score is log P(a segmentation's value exceeds the best one not emitted).

All draws are counters hashed with the row's key, so a row's samples do not depend on
the batch it is in.  Null and empty texts have one segmentation, of no pieces; a text
with fewer than ``k`` segmentations gives those it has.  Repeated rows (the same key and
text) give the same samples.  Decoding gives the text back unless it holds U+2581, which
stands for the space.  Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, slices, texts_of
from tidemark.llm.language import Slots

K, ALPHA, OFFSET, DEEP = 2, 1.0, 100.0, 34.0
VOCABULARY, SPACE = "piece_bpe_32k.model", "▁"
_BLOCK, BATCH = 3_000_000, 1000  # characters and rows that share a lattice
_UNIT = re.compile(" +[^ ]*")
_WORD = (1 << 64) - 1
_GOLD, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: counters become uncorrelated bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    """``mixed`` of one number."""
    x = ((x ^ (x >> 30)) * int(_A)) & _WORD
    x = ((x ^ (x >> 27)) * int(_B)) & _WORD
    return x ^ (x >> 31)


def uniform(key: np.ndarray, at) -> np.ndarray:
    """Numbers in (0, 1) of a key and a counter."""
    bits = mixed(key + (np.atleast_1d(np.asarray(at, np.uint64)) + np.uint64(1)) * _GOLD)
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def uniform_one(key: int, at: int) -> float:
    """``uniform`` of one key and one counter."""
    return ((mixed_one((key + (at + 1) * int(_GOLD)) & _WORD) >> 11) + 0.5) / (1 << 53)


def stream(key: int, tag: int) -> int:
    """Another key for each tag."""
    return mixed_one((key + mixed_one((tag * int(_GOLD)) & _WORD)) & _WORD)


class Vocabulary:
    """Pieces, their log weights and their trie."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.shown = [chr(int(p[3:5], 16)) if model.is_byte(i) else p for i, p in enumerate(self.pieces)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = np.array([min(-model.get_score(i), n) if model.get_score(i) > -1e8 else 0.0 for i in range(n)])
        self.weight = -ALPHA * np.log(OFFSET + np.maximum(rank, 0))
        self.spelled = -ALPHA * np.log(OFFSET + n)
        child: dict[tuple[int, str], int] = {}
        ends = [-1]
        for i in plain:
            node = 0
            for c in self.pieces[i]:
                if (node, c) not in child:
                    child[node, c] = len(ends)
                    ends.append(-1)
                node = child[node, c]
            ends[node] = i
        self.ends = np.array(ends)
        self.slots = Slots(np.array([(node << 21) | ord(c) for node, c in child], np.uint64))
        self.target = np.array([*child.values(), -1])
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.plain = set(plain)

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        """Token ids of edges; a negative edge is a character spelled in bytes."""
        if not len(pieces) or pieces.min() >= 0:
            return pieces
        plain = np.where(pieces < 0, self.byte_ids[0] - 1 - pieces, pieces)
        if pieces.min() >= -128:
            return plain
        return np.array([i for p in pieces.tolist() for i in ([p] if p >= 0 else [self.byte_ids[b] for b in chr(-p - 1).encode("utf-8", "replace")])], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids."""
        first, ids = self.byte_ids[0], np.asarray(ids, np.int64)
        wide = bool(((ids >= first + 128) & (ids < first + 256)).any())
        ids = ids.tolist()
        if not wide:
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            text = b"".join(bytes([i - first]) if first <= i < first + 256 else self.pieces[i].encode() for i in ids).decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Edges of distinct units with their log-probabilities given the start; unit u begins at position ``start[u]``.

    Positions are numbered by their distance from the end of their unit, so a backward
    step is one slice; the first ``finals`` of them are the ends.  Edges stand by their
    position and then by length, which needs no sorting.
    """

    def __init__(self, units: list[str], words: Vocabulary):
        size = np.fromiter(map(len, units), np.int32, len(units))
        order = np.argsort(-size, kind="stable")
        codes = np.frombuffer("".join([units[u] for u in order.tolist()]).encode("utf-32-le", "replace"), np.uint32)
        size, self.finals = size[order], len(units)
        # positions of a distance are numbered along the units that are as long
        level = np.r_[0, np.cumsum(np.r_[len(units), np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")])].astype(np.int32)
        self.start = np.zeros(len(units), np.int32)
        self.start[order] = level[size] + np.arange(len(units), dtype=np.int32)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
        left = np.repeat(np.cumsum(size), size).astype(np.int32) - np.arange(len(codes), dtype=np.int32)  # characters to the end of the unit
        place = level[left] + unit - np.int32(self.finals)
        at, node = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int64)
        found, count = [], np.zeros(len(codes), np.int32)
        for length in range(1, words.longest + 1):
            child = words.slots.find((node.view(np.uint64) << np.uint64(21)) | codes[at + np.int32(length - 1)])
            alive = child >= 0
            if length == 1:
                odd = np.flatnonzero(~alive).astype(np.int32)
            at, node = at[alive], words.target[child[alive]]
            ends = words.ends[node]
            hit = ends >= 0
            hits, pieces = at[hit], ends[hit].astype(np.int32)
            if length == 1:
                odd = np.r_[odd, at[~hit]]
                found.append((1, odd, -codes[odd].astype(np.int32) - 1))
                count[place[odd]] += 1
            found.append((length, hits, pieces))
            count[place[hits]] += 1
            more = left[at] > length
            at, node = at[more], node[more]
        self.head = np.r_[0, np.cumsum(count)]
        free = self.head[:-1].astype(np.int32)
        self.dst, self.piece, weight = np.zeros(self.head[-1], np.int32), np.zeros(self.head[-1], np.int32), np.zeros(self.head[-1])
        for length, hits, pieces in found:
            own = place[hits]
            slot = free[own]
            free[own] = slot + 1
            self.dst[slot] = level[left[hits] - np.int32(length)] + unit[hits]
            self.piece[slot] = pieces
            weight[slot] = words.weight[pieces] if not len(pieces) or pieces[0] >= 0 else words.spelled * np.where(pieces >= -0x80, 1, np.where(pieces >= -0x800, 2, np.where(pieces >= -0x10000, 3, 4)))
        del found, unit, left, place, free
        beta = np.zeros(len(codes) + len(units))
        self.log = weight
        for a, b in zip(level[1:-1].tolist(), level[2:].tolist()):
            h = self.head[a - self.finals:b - self.finals]
            edges = slice(h[0], self.head[b - self.finals])
            ahead = weight[edges] + beta[self.dst[edges]]
            beta[a:b] = np.logaddexp.reduceat(ahead, h - h[0])
            self.log[edges] = np.minimum(ahead - np.repeat(beta[a:b], count[a - self.finals:b - self.finals]), 0.0)
        # of each position the likeliest edge and its probability, and the running sum of the others
        heads, p = self.head[:-1], np.exp(self.log)
        self.high = np.maximum.reduceat(p, heads) if len(heads) else p
        at = np.flatnonzero(p == np.repeat(self.high, count))
        of = np.searchsorted(self.head, at, "right") - 1 if len(at) > len(heads) else np.arange(len(heads))
        self.likely = np.zeros(len(heads), np.int64)
        self.likely[of[::-1]] = at[::-1]
        p[self.likely] = 0.0
        total = np.cumsum(p)
        p = np.minimum(total - np.repeat(total[heads] - p[heads], count), 1.0)
        p += np.repeat(np.arange(len(heads), dtype=np.int32), count)
        self.upto = p

    def edges(self, position: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each position, drawn by u."""
        group = position - self.finals
        e, rest = self.likely[group], u - self.high[group]
        other = np.flatnonzero(rest >= 0)
        if len(other):
            found = np.searchsorted(self.upto, group[other] + rest[other], side="right")
            inside = found < self.head[group[other] + 1]  # else rounding, and the likeliest will do
            e[other[inside]] = found[inside]
        return e

    def group(self, edge: int) -> int:
        """The position of an edge, counted without the ends."""
        return int(self.head.searchsorted(edge, "right")) - 1

    def edge(self, position: int, u: float) -> int:
        """``edges`` of one position."""
        group = position - self.finals
        rest = u - self.high[group]
        if rest >= 0:
            a, b = self.head[group:group + 2]
            found = a + int(self.upto[a:b].searchsorted(group + rest, "right"))
            if found < b:
                return int(found)
        return int(self.likely[group])

    def walk(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Freely sampled paths of unit occurrences, end to end, and where each begins."""
        now, position, steps = np.arange(len(units)), self.start[units], []
        now, position = now[position >= self.finals], position[position >= self.finals]
        count = np.zeros(len(units), np.int64)
        while len(now):
            e = self.edges(position, uniform(keys[now], len(steps)))
            steps.append((now, e))
            count[now] += 1
            position = self.dst[e]
            open_ = position >= self.finals
            now, position = now[open_], position[open_]
        begin = np.r_[0, np.cumsum(count)]
        out = np.zeros(begin[-1], np.int32)
        for s, (now, e) in enumerate(steps):
            out[begin[now] + s] = e
        return out, begin


def _regions(lattice: Lattice, path: np.ndarray, logs: np.ndarray, from_step: int, base: float, excluded: tuple[int, ...], bound: float, key: int):
    """Best values of the regions along a path from ``from_step`` on, whose step before has log-probability ``base``."""
    log = logs[from_step:]
    before = base + np.cumsum(log) - log
    n = int(np.searchsorted(-before, DEEP, "right"))
    if not n:
        return np.zeros(0), np.zeros(0)
    log, before = log[:n], before[:n]
    left = -np.expm1(log)
    if excluded:
        left[0] = left[0] - sum(np.exp(lattice.log[e]) for e in excluded)
        own = lattice.group(path[from_step])
        if lattice.head[own + 1] - lattice.head[own] == len(excluded) + 1:
            left[0] = 0.0
    with np.errstate(divide="ignore"):
        mass = before + np.log(np.maximum(left, 0.0) * (left > 1e-15))
        value = mass - np.log(np.exp(np.minimum(mass - bound, 700)) - np.log(uniform(np.array([key], np.uint64), np.arange(n))))
    return np.where(np.isfinite(mass), value, -np.inf), before


def top_k(lattice: Lattice, paths, unit_of, key: int, k: int):
    """(path, log probability, value) of up to k samples of a text, and the best value left out.

    ``paths(s)`` is the freely sampled path number s with the steps at which its units
    begin, ``unit_of`` each position's unit in the text.
    """
    first, begins = paths(0)
    root = float(-np.log(-np.log(uniform_one(key, 1 << 40))))
    found, heap, turn = [], [], 0

    def emit(path: np.ndarray, value: float, from_step: int, base: float, excluded: tuple[int, ...]):
        logs = lattice.log[path]
        found.append((path, float(logs.sum()), value))
        values, before = _regions(lattice, path, logs, from_step, base, excluded, value, stream(key, (1 << 41) + len(found)))
        most = k + 1 - len(found)  # more can never be opened, or be the best one left
        if not len(values):
            return
        for i in [int(values.argmax())] if most == 1 else np.argsort(-values, kind="stable")[:most]:
            if np.isfinite(values[i]):
                taken = (*excluded, int(path[from_step + i])) if i == 0 else (int(path[from_step + i]),)
                heapq.heappush(heap, (-values[i], len(found), int(i), path, from_step + int(i), float(before[i]), taken))
    emit(first, root, 0, 0.0, ())
    while heap and len(found) < k:
        value, _, _, path, step, base, taken = heapq.heappop(heap)
        turn += 1
        own = lattice.group(path[step])
        edges = [e for e in range(lattice.head[own], lattice.head[own + 1]) if e not in taken]
        p = np.cumsum(np.exp(lattice.log[edges]))
        own_stream = stream(key, (1 << 42) + turn)
        e = edges[min(int(p.searchsorted(uniform_one(own_stream, 0) * p[-1], "right")), len(edges) - 1)]
        part, position = [e], int(lattice.dst[e])
        while position >= lattice.finals:
            e = lattice.edge(position, uniform_one(own_stream, len(part)))
            part.append(e)
            position = int(lattice.dst[e])
        unit = unit_of(path, step)
        free, free_begins = paths(turn)
        emit(np.concatenate([path[:step], part, free[free_begins[unit + 1]:]]).astype(np.int32), -value, step, base, taken)
    return found, (-heap[0][0] if heap else -np.inf)


def units(text: str) -> list[str]:
    """A text in parts that no piece crosses: words with the spaces before them, the first of which goes without saying."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(" " + text)]


class _Index(dict):
    """Numbers units in the order of their first use."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def samples(texts: list[str], keys: np.ndarray, words: Vocabulary, k: int = K):
    """For each text its samples as (ids, log probability, value, log inclusion)."""
    units_of = [units(t) for t in texts]
    number = _Index()
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(units_of)), np.int64)
    counts = np.fromiter(map(len, units_of), np.int64, len(texts))
    lattice = Lattice([SPACE + u.replace(" ", SPACE) for u in number], words)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(flat)) - np.repeat(ends - counts, counts)
    walks = []
    for s in range(k):
        walks.append(lattice.walk(flat, mixed(keys[owner] + mixed(np.array([s + 1], np.uint64) * _GOLD + nth.astype(np.uint64)))))
    for i in range(len(texts)):
        a, b = ends[i] - counts[i], ends[i]
        if a == b:
            yield [(np.zeros(0, np.int64), 0.0, 0.0, 0.0)]
            continue

        def paths(s: int, a=a, b=b):
            path, begin = walks[s]
            return path[begin[a]:begin[b]], begin[a:b + 1] - begin[a]

        def unit_of(path: np.ndarray, step: int) -> int:
            return int(np.count_nonzero(lattice.dst[path[:step]] < lattice.finals))
        found, rest = top_k(lattice, paths, unit_of, int(keys[i]), k)
        yield [(words.ids(lattice.piece[p]), log, value, _log_inclusion(log - rest)) for p, log, value in found]


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x < -30:
        return float(x)
    return float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def sampled(docs: DataFrame, k: int = K, path: str | None = None) -> DataFrame:
    """(doc_id, sample, ids, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, whole) for every row; ``whole`` says that decoding gives the text back."""
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "whole"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, texts = vocabulary(path), texts_of(batch)
        keys = batch.column("key").to_numpy().view(np.uint64)
        out = {n: [] for n in names[2:]}
        row, drawn = [], []
        for a, b in slices(map(len, texts), _BLOCK):
            for i, found in enumerate(samples(texts[a:b], keys[a:b], words, k)):
                for s, (ids, log, value, score) in enumerate(found):
                    row.append(a + i), drawn.append(ids.astype(np.int32))
                    for n, v in zip(names[2:], (s + 1, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log, value, score, words.decode(ids) == texts[a + i])):
                        out[n].append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        ends = np.r_[0, np.cumsum(out["n_pieces"])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(drawn)))
        return pa.record_batch([batch.column("doc_id").take(pa.array(row)), ids, *(pa.array(out[n], t) for n, t in zip(names[2:], kinds))], names)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    source = docs.select("doc_id", F.xxhash64(F.lit("row"), "doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    return arrow_rows(source, work, f"doc_id {kind}, ids array<int>, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, whole boolean")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with the ``text`` that their ``ids`` spell; null ids give a null text."""
    path = path or vocabulary_path()
    source = rows.select(F.struct(*(c for c in rows.columns if c != "text")).alias("row"), F.col("ids").cast("array<int>").alias("ids"))
    kind = source.schema["row"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = vocabulary(path)
        texts = [None if ids is None else words.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
        return pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])
    return arrow_rows(source, work, f"row {kind}, text string").select("row.*", "text")


def query(docs: DataFrame) -> DataFrame:
    return sampled(docs)
