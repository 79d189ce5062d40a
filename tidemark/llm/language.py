"""Language identification by prediction by partial matching.

Every language has a variable-order context tree over the bytes of lower-cased text.
A byte seen in its longest context costs -log2(n / (n + d)), n being that context's
count and d its number of distinct bytes; otherwise the context's escape d / (n + d)
is paid and the next shorter context decides, with the bytes that the longer one
holds excluded, down to a uniform order.  So the costs of the 256 bytes of any
context sum to one probability, and the frozen trees give exact code lengths.

As the statistics are frozen, the cost of a byte depends on the ``ORDER`` bytes before
it only: tables of byte groups hold the costs under all languages at once and numpy
reads whole batches.  The text goes to the language with the shortest code; the score
is its share of probability over all languages, which counts as equally likely.

Null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing was learnt.  Equal code lengths go to the smaller language name.  Repeated
rows are answered each; only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, ranked_share, remainder

#: Bytes of context; documents a language that the trees are built from, and their mean length at most.
ORDER, FIT_ROWS, FIT_LONGEST = 3, 800, 20_000
HELD_OUT, UNKNOWN = 5, "und"
_BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lettered(text: str) -> bool:
    """Whether a text has a letter; fractions and raised digits are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class Slots:
    """Row of a 64-bit key by open addressing, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.probes = 0
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._at(keys[left], self.probes)
            free = self.row[at] < 0
            at, mine = at[free], left[free]
            self.row[at] = mine  # of several keys for a slot, one stays
            won = self.row[at] == mine
            self.key[at[won]] = keys[mine[won]]
            held = np.zeros(len(keys), bool)
            held[mine[won]] = True
            left = left[~held[left]]
            self.probes += 1

    def _at(self, keys: np.ndarray, probe: int) -> np.ndarray:
        home = (keys * _MIX) >> np.uint64(64 - self.bits)
        return ((home + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._at(keys, 0)
        out = np.where(self.key[at] == keys, self.row[at], -1)
        left = np.flatnonzero((out < 0) & (self.row[at] >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = self._at(keys[left], probe)
            hit = (self.key[at] == keys[left]) & (self.row[at] >= 0)
            out[left[hit]] = self.row[at[hit]]
            left = left[~hit & (self.row[at] >= 0)]
        return out


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes that end at each position from width - 1 on, as one number."""
    n = len(data) - width + 1
    code = np.zeros(n, np.uint64)
    for j in range(width):
        code = (code << np.uint64(8)) | data[j:j + n].astype(np.uint64)
    return code


def _low(codes: np.ndarray, width: int) -> np.ndarray:
    return codes & np.uint64((1 << (8 * width)) - 1)


class _Tree:
    """Costs of one language: for each order the seen groups and the escapes of its contexts."""

    def __init__(self, texts: list[bytes], order: int):
        pad = bytes(order)
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + order for t in texts)])[:-1]
        real = np.ones(len(data), bool)
        for j in range(order):
            real[starts + j] = False
        self.base = np.full(256, 8.0)
        self.orders = []
        for k in range(order + 1):
            codes = _codes(data, k + 1)[real[k:]]
            seen, count = np.unique(codes, return_counts=True)
            if not k:
                total, kinds = count.sum(), len(seen)
                escape = kinds / (total + kinds) if kinds < 256 else 0.0
                if len(seen):
                    self.base[:] = -np.log2(escape / (256 - kinds)) if kinds < 256 else 0.0
                    self.base[seen.astype(int)] = -np.log2(count / total * (1 - escape))
                continue
            context = seen >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(seen) else np.zeros(0, int)
            total, kinds = np.add.reduceat(count, first) if len(first) else count, np.diff(np.r_[first, len(seen)])
            below = np.exp2(-self.cost(_low(seen, k), k - 1))
            free = np.maximum(1 - (np.add.reduceat(below, first) if len(first) else below), 1e-9)
            cost = -np.log2(count / np.repeat(total + kinds, kinds))
            self.orders.append((seen, cost, context[first], -np.log2(kinds / (total + kinds) / free)))

    def cost(self, codes: np.ndarray, k: int) -> np.ndarray:
        if not k:
            return self.base[codes.astype(int)]
        seen, cost, contexts, escape = self.orders[k - 1]
        out, hit = _pick(seen, cost, codes)
        miss = codes[~hit]
        out[~hit] = _pick(contexts, escape, miss >> np.uint64(8))[0] + self.cost(_low(miss, k), k - 1)
        return out


def _pick(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys, 0 where absent, and which were found."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


@dataclass
class Coder:
    """Costs under all languages: a row of floats for each group of order + 1 bytes."""

    names: list[str]
    order: int
    base: np.ndarray
    levels: list[tuple[Slots, np.ndarray, Slots, np.ndarray]]

    def cost(self, codes: np.ndarray, k: int) -> np.ndarray:
        if not k:
            return self.base[codes.astype(np.int64)]
        groups, cost, contexts, escape = self.levels[k - 1]
        at = groups.find(codes)
        out = cost[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            code = codes[miss]
            found = contexts.find(code >> np.uint64(8))
            out[miss] = self.cost(_low(code, k), k - 1) + np.where((found < 0)[:, None], 0, escape[found])
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language."""
        pad = bytes(self.order)
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + self.order for t in texts)])
        out = np.zeros((len(texts), len(self.names)))
        for a in range(0, len(data), _BLOCK):
            b = min(a + _BLOCK, len(data))
            part = data[max(a - self.order, 0):b]
            lead = a - max(a - self.order, 0)
            cost = np.zeros((b - a, len(self.names)), np.float32)
            skip = self.order - lead  # only the first block begins inside padding
            cost[skip:] = self.cost(_codes(part, self.order + 1), self.order)
            i, j = np.searchsorted(starts, [a, b - 1], side="right") - 1
            for x in range(self.order):
                edge = starts[i:j + 1] + x - a
                cost[edge[(edge >= 0) & (edge < b - a)]] = 0
            cuts = np.maximum(starts[i:j + 1] - a, 0)
            out[i:j + 1] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
        return out

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of probability and bits a byte of each text."""
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        open_ = np.array([bool(self.names) and bool(t) and lettered(t) for t in texts])
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.bits(raw)
        pick = bits.argmin(1)
        least = bits[np.arange(len(texts)), pick]
        share = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
        rate = least / np.maximum([len(r) for r in raw], 1)
        return [self.names[p] if o else UNKNOWN for p, o in zip(pick, open_)], np.where(open_, share, 0.0), np.where(open_, rate, 0.0)


def build(texts: dict[str, list[str]], order: int = ORDER) -> Coder:
    """Context trees of the texts of each language, as common tables."""
    names = sorted(texts)
    trees = [_Tree([t.lower().encode("utf-8", "replace") for t in texts[n]], order) for n in names]
    base = np.stack([t.base for t in trees], 1).astype(np.float32) if names else np.zeros((256, 0), np.float32)
    levels = []
    for k in range(1, order + 1):
        groups = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.orders[k - 1][0] for t in trees)]))
        contexts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.orders[k - 1][2] for t in trees)]))
        cost = np.stack([t.cost(groups, k) for t in trees], 1) if names else np.zeros((0, 0))
        escape = np.stack([_pick(t.orders[k - 1][2], t.orders[k - 1][3], contexts)[0] for t in trees], 1) if names else np.zeros((0, 0))
        blank = np.zeros((1, len(names)), np.float32)  # read by row -1
        levels.append((Slots(groups), np.concatenate([cost.astype(np.float32), blank]), Slots(contexts), np.concatenate([escape.astype(np.float32), blank])))
    return Coder(names, order, base, levels)


def fit(docs: DataFrame, rows: int = FIT_ROWS, longest: int = FIT_LONGEST, order: int = ORDER) -> Coder:
    """Trees from at most ``rows`` documents of each language that may be learnt from.

    A language's texts have ``rows`` times ``longest`` characters at most: where there are
    fewer than ``rows`` documents, each may be longer in proportion; only what is beyond
    that is left out of a text.  A language without a text that is not null has no tree.
    """
    known = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", HELD_OUT) != 0))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(drawn).alias("least")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return build({}, order)
    least = {r["lang"]: r["least"] for r in found}  # so that at least one document is drawn
    share = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, max(int(min(1.0, rows / n) * (1 << 30)), least[name] + 1))))
    most = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, rows * longest // min(n, rows))))
    sample = known.where(drawn < share[F.col("lang")]).withColumn("text", F.col("text").substr(F.lit(1), most[F.col("lang")])).dropDuplicates(["doc_id", "lang", "text"])
    texts: dict[str, list[str]] = {name: [] for name in counts}
    for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect():
        if len(texts[r["lang"]]) < rows:
            texts[r["lang"]].append(r["text"])
    return build(texts, order)


def marked(docs: DataFrame, model: Coder, keep: list[str]) -> DataFrame:
    """(row, lang_pred, score, bits_per_byte): ``row`` holds the ``keep`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, share, rate = shared.value.best(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("row"), pa.array(name, pa.string()), pa.array(share), pa.array(rate)], ["row", "lang_pred", "score", "bits_per_byte"])
    return arrow_rows(source, work, f"row {kind}, lang_pred string, score double, bits_per_byte double")


def kept(docs: DataFrame, model: Coder, least: float = 0.0) -> DataFrame:
    """The rows with a recognised language, which replaces ``lang``; a caller may ask for a score of ``least`` too."""
    found = marked(docs, model, docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.{c}") for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return marked(docs, fit(docs), ["doc_id"]).select("row.doc_id", (remainder("row.doc_id", HELD_OUT) == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")
