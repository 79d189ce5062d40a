"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted batch by batch (bytes by class, words, lines).
The trees are grown on a bounded sample of labelled rows from histograms of at most
``BINS`` quantile bins, then flattened into arrays that numpy walks level by level
for all rows and trees of a batch.

Null and empty texts have all statistics zero and get a score like any other row.
Repeated rows are scored each; columns other than doc_id and text are not read.
Without labelled rows the score is 0.5; with one class only it is that class's
smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, labelled_sample, remainder, slices, texts_of

#: Bound of the sample that the trees are grown on.
FIT_ROWS = 20_000
BINS = 128
HELD_OUT, THRESHOLD = 5, 0.3

NAMES = ("chars", "words", "lower", "upper", "digit", "space", "newline", "stop", "bang", "symbol", "wide", "word_length", "longest_word",
         "distinct_words", "distinct_pairs", "repeats", "lines", "distinct_lines", "words_per_line", "top_symbol")
_CLASSES = 9


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 7, np.uint8)
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?")):
        kinds[list(members)] = k
    kinds[128:] = 8
    return kinds


_KINDS = _byte_classes()
_BLOCK = 1 << 21


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    out = np.zeros((len(texts), len(NAMES)))
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.zeros((len(texts), _CLASSES))
    for a, b in slices(map(len, raw), _BLOCK):
        data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
        owner = np.repeat(np.arange(b - a, dtype=np.int32) * _CLASSES, [len(x) for x in raw[a:b]])
        for at in range(0, len(data), _BLOCK):
            key = owner[at:at + _BLOCK] + _KINDS[data[at:at + _BLOCK]]
            counts[a:b] += np.bincount(key, minlength=(b - a) * _CLASSES).reshape(b - a, _CLASSES)
    size = np.maximum(counts.sum(1), 1)
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        lines = [x for x in text.split("\n") if x]
        out[i, 1] = n
        out[i, 11] = sum(map(len, words)) / n
        out[i, 12] = len(max(words, key=len))
        out[i, 13] = len(set(words)) / n
        out[i, 14] = len(set(zip(words, words[1:]))) / max(n - 1, 1)
        out[i, 15] = sum(map(eq, words, words[1:])) / n
        out[i, 16] = np.log1p(len(lines))
        out[i, 17] = len(set(lines)) / max(len(lines), 1)
        out[i, 18] = n / max(len(lines), 1)
        out[i, 19] = max(map(text.count, "|#$%&*@{<=")) / n
    out[:, 0] = np.log1p(counts.sum(1))
    out[:, 1] = np.log1p(out[:, 1])
    out[:, 2:11] = counts / size[:, None]
    return out


@dataclass
class Forest:
    """Trees as arrays: children of node i are ``left[i]`` and ``left[i] + 1``; a leaf points to itself."""

    start: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if not len(self.roots):
            return total
        node = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = self.left[node]
            node = np.where(below == node, node, below + (x[rows, self.feature[node]] > self.limit[node]))
        return total + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boost ``trees`` trees for the logistic loss, splitting on histograms of gradients."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Forest(start, 0, none, none, np.zeros(0), none, np.zeros(0))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)
    margin = np.full(len(y), start)
    roots, feature, limit, left, value = [], [], [], [], []

    def add() -> int:
        feature.append(0), limit.append(0.0), left.append(len(left)), value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(add())
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for node, rows in open_nodes:
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = -rate * g / (h + ridge)
                best = (1e-6, -1, 0)
                for j in range(len(edges)) if level < depth and len(rows) >= 2 * least else ():
                    bins = binned[j, rows]
                    gl = np.cumsum(np.bincount(bins, grad[rows], len(edges[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins, hess[rows], len(edges[j]) + 1))[:-1]
                    nl = np.cumsum(np.bincount(bins, minlength=len(edges[j]) + 1))[:-1]
                    gain = np.where((nl >= least) & (len(rows) - nl >= least), gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge), -1)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
                if best[1] >= 0:
                    _, j, k = best
                    feature[node], limit[node] = j, float(edges[j][k])
                    low = binned[j, rows] <= k
                    left[node] = add()
                    add()
                    following += [(left[node], rows[low]), (left[node] + 1, rows[~low])]
                else:
                    margin[rows] += value[node]
            open_nodes = following
    return Forest(start, depth, np.array(roots), np.array(feature), np.array(limit), np.array(left), np.array(value))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **growth) -> Forest:
    """Trees from at most ``rows`` labelled documents; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", HELD_OUT) != 0, rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = statistics(texts_of(batch))
        return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(stats.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "stats"])
    kind = sample.schema["doc_id"].dataType.simpleString()
    got = arrow_rows(sample, work, f"doc_id {kind}, y int, stats array<double>").orderBy("doc_id").collect()
    x = np.array([r.stats for r in got]).reshape(len(got), len(NAMES))
    return grow(x, np.array([float(r.y > 0) for r in got]), **growth)


def marked(docs: DataFrame, model: Forest, keep: list[str]) -> DataFrame:
    """(row, quality_score) of every row: ``row`` holds the ``keep`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("row"), pa.array(shared.value.score(statistics(texts_of(batch))))], ["row", "quality_score"])
    return arrow_rows(source, work, f"row {kind}, quality_score double")


def kept(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, with their own columns only."""
    return marked(docs, model, docs.columns).where(F.col("quality_score") >= threshold).select("row.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = marked(docs, fit(docs, labels), ["doc_id"])
    return found.select("row.doc_id", (remainder("row.doc_id", HELD_OUT) == 0).alias("held_out"), F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
