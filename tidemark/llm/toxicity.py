"""Toxic spans by a linear-chain conditional random field.

Labels speak of documents, so tokens are labelled first.  Features (a word, its first
four or five letters) that stand out by at least ``EVIDENCE`` in log-odds between toxic
and other training documents tell toxic tokens if they are in a share of ``COMMON`` of
the toxic documents, or are needed to explain ``SUPPORT`` more of them; a token with one
in a toxic document is toxic, everything else is clean.  The field has two states,
weights for those features and for the four steps between states, and is fitted by
gradient steps on its exact likelihood, whose expectations come from forward-backward.

Scoring runs forward-backward over whole texts: the tokens of a batch form one chain in
which a document's first token does not depend on the one before, cut into blocks that
numpy advances together.  A document's probability is a logistic function of three sums
over its token marginals: the expected number of toxic tokens, the chance of at least
one, and the largest marginal.  Tokens with a marginal of one half or more give the
offending offsets (code points, end exclusive).

A token is a run between white space; its features are those of its longest word (run of
letters), in lower case.  Null and empty texts and texts without a word
have no marginals and get the score of a document without toxic tokens.  Repeated rows
are scored each; columns other than doc_id and text are not read.  Without labelled
rows, or with one class only, no token is toxic and the score is the smoothed share of
label 1 (0.5 without rows).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut, labelled_sample, remainder, slices, texts_of

#: Bounds of the sample that the model is fitted on: documents, and characters of all of them.
FIT_ROWS, FIT_CHARS = 5000, 10_000_000
HELD_OUT, THRESHOLD = 3, 0.7
EVIDENCE, SUPPORT, COMMON = 4.0, 5, 0.02
#: Documents of each class whose tokens the field is fitted on.
FIELD_ROWS = 600
REMEMBERED = 300_000
_WORD, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\S+")
_BLOCK = 1 << 21


def features(run: str) -> tuple[str, ...]:
    """The longest word of a run between spaces and its beginnings; beginnings need five letters."""
    word = run.lower()
    if not word.isalpha():
        word = max(_WORD.findall(word), key=len, default="")
    if len(word) >= 5:
        return "=" + word, "4" + word[:4], "5" + word[:5]
    return ("=" + word,) if word else ()


def telling(docs: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Flags of the features that tell toxic documents: common in them, or needed to explain some, and rare elsewhere.

    ``docs`` holds each document's distinct features as numbers below ``size``.
    """
    none = [np.zeros(0, np.int64)]
    seen = [np.bincount(np.concatenate(none + [d for d, y in zip(docs, toxic) if y == label]), minlength=size) for label in (0, 1)]
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    odd = (seen[1] >= SUPPORT) & (np.log((seen[1] + 0.5) / (n1 + 1) / ((seen[0] + 0.5) / (n0 + 1))) >= EVIDENCE)
    chosen = odd & (seen[1] >= COMMON * n1)
    left = [d[odd[d]] for d, y in zip(docs, toxic) if y and not chosen[d].any()]
    while left:
        counts = np.bincount(np.concatenate(none + left), minlength=1)
        best = int(counts.argmax())
        if counts[best] < SUPPORT:
            break
        chosen[best] = True
        left = [d for d in left if best not in d]
    return chosen


def _messages(odds: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Odds of state 1 given the tokens so far, for chains laid end to end.

    The chain is cut into blocks that advance together.  What enters a block is what
    leaves the one before it; passes are repeated until that no longer changes, which is
    after two as a rule, as a message forgets its start within a few tokens.
    """
    n = len(odds)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    own, new = np.ones((2, width * blocks))
    own[:n], new[:n] = odds, first
    own, new = own.reshape(blocks, width).T.copy(), new.reshape(blocks, width).T > 0
    some = new.any(1).tolist()
    out, enter = np.empty((width, blocks)), np.ones(blocks)
    for _ in range(blocks + 1):
        r = enter
        for t in range(width):
            r = (w[0, 1] + w[1, 1] * r) / (w[0, 0] + w[1, 0] * r)
            if some[t]:
                r[new[t]] = 1.0
            r *= own[t]
            out[t] = r
        following = np.r_[1.0, r[:-1]]
        if np.allclose(following, enter, rtol=1e-12, atol=0):
            break
        enter = following
    return out.T.reshape(-1)[:n]


def forward_backward(emission: np.ndarray, fresh: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token: marginal of state 1, and the shares of state 1 in the messages
    from before and from behind, each with the token's own weight.

    ``emission`` is the log-odds of state 1, ``fresh`` marks the first tokens of chains,
    ``step`` holds the log weights from state to state.
    """
    if not len(emission):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    odds, w = np.exp(np.clip(emission, -30, 30)), np.exp(step)
    ahead = _messages(odds, fresh, w)
    last = np.r_[fresh[1:], True]
    behind = _messages(odds[::-1], last[::-1], w.T)[::-1]
    both = ahead * behind / odds
    return both / (1 + both), ahead / (1 + ahead), behind / (1 + behind)


def _steps(ahead: np.ndarray, behind: np.ndarray, step: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected number of steps between each two states."""
    pair = np.stack([1 - ahead[:-1], ahead[:-1]])[:, None] * np.exp(step)[:, :, None] * np.stack([1 - behind[1:], behind[1:]])[None]
    return (pair / pair.sum((0, 1)))[:, :, inner].sum(2)


class Emissions(dict):
    """Log-odds of state 1 of runs, worked out when first asked for."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weight, self.bias = weights.get, bias

    def __missing__(self, run: str) -> float:
        get = self.weight
        self[run] = found = self.bias + sum([get(f, 0.0) for f in features(run)])
        return found


@dataclass
class Field:
    """Feature weights (log-odds of toxic), step weights and the document's logistic weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: np.ndarray = field(default_factory=lambda: np.zeros(4))
    known: Emissions | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": None}

    def marginals(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Runs of each text, their counts and the marginals of all, end to end."""
        words = [t.split() for t in texts]
        counts = np.array([len(w) for w in words])
        if self.known is None or len(self.known) > REMEMBERED:
            self.known = Emissions(self.weights, self.bias)
        get = self.known.__getitem__
        emission = np.fromiter((e for doc in words for e in map(get, doc)), float, int(counts.sum()))
        fresh = np.zeros(len(emission), bool)
        fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
        return words, counts, forward_backward(emission, fresh, self.step)[0]

    def sums(self, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected toxic tokens (log), chance of one (log-odds, bounded) and largest marginal of each text."""
        out = np.zeros((len(counts), 4))
        out[:, 0] = 1
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            out[some, 1] = np.log1p(np.add.reduceat(p, starts))
            out[some, 2] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), starts))
            out[some, 3] = np.maximum.reduceat(p, starts)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score and offending offsets of each text."""
        scores, found = np.zeros(len(texts)), []
        for a, b in slices(map(len, texts), _BLOCK):
            _, counts, p = self.marginals(texts[a:b])
            scores[a:b] = 1 / (1 + np.exp(-np.clip(self.sums(counts, p) @ self.head, -40, 40)))
            ends = np.cumsum(counts)
            for i in range(b - a):
                hit = np.flatnonzero(p[ends[i] - counts[i]:ends[i]] >= 0.5)
                found.append(_offsets(texts[a + i], hit) if len(hit) else [])
        return scores, found


def _offsets(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Offsets of the longest word of each run numbered in ``hit``."""
    runs = [m.span() for m in _RUN.finditer(text)]
    words = (max(_WORD.finditer(text, *runs[k]), key=lambda m: m.end() - m.start(), default=None) for k in hit.tolist())
    return [m.span() for m in words if m]


def fit_field(texts: list[str], y: np.ndarray, rounds: int = 80, field_rows: int = FIELD_ROWS) -> Field:
    """The field and the document's logistic weights from labelled texts."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    head = np.array([np.log(share / (1 - share)), 0, 0, 0])
    if not len(y) or y.min() == y.max():
        return Field(head=head)
    once = dict(zip(texts, y))  # copies would lend their words weight
    number: dict[str, int] = {}
    of: dict[str, tuple[int, ...]] = {}

    def numbers(run: str) -> tuple[int, ...]:
        if run not in of:
            of[run] = tuple(number.setdefault(f, len(number)) for f in features(run))
        return of[run]
    found = [np.unique(np.fromiter((k for r in set(t.split()) for k in numbers(r)), np.int64)) for t in once]
    labels = np.array(list(once.values()))
    signs = telling(found, labels, len(number))
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=len(number))
    place = np.where(seen >= SUPPORT, np.cumsum(seen >= SUPPORT), 0)  # 0 is for features seen less
    few = [t for label in (0, 1) for t in [t for t, v in once.items() if v == label][:field_rows]]
    runs = [t.split() for t in few]
    fresh = np.concatenate([np.r_[True, np.zeros(len(d) - 1, bool)] for d in runs if d] or [np.zeros(0, bool)])
    index = np.zeros((len(fresh), 3), np.int64)
    toxic = np.zeros(len(fresh))
    at = 0
    for t, d in zip(few, runs):
        for r in d:
            held = list(of[r])
            index[at, :len(held)] = place[held]
            toxic[at] = bool(once[t]) and signs[held].any()
            at += 1
    weights, bias, step = np.zeros(int(place.max(initial=0)) + 1), -6.0, np.zeros((2, 2))
    memory, step_memory = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    told = np.zeros((2, 2))
    inner = ~fresh[1:]
    for a in (0, 1):
        for b in (0, 1):
            told[a, b] = ((toxic[:-1] == a) & (toxic[1:] == b) & inner).sum()
    for _ in range(rounds if len(fresh) else 0):
        p, ahead, behind = forward_backward(bias + weights[index].sum(1), fresh, step)
        off = toxic - p
        grad = np.bincount(index.reshape(-1), np.repeat(off, 3), len(weights)) - 0.01 * weights
        grad[0] = 0
        step_grad = told - _steps(ahead, behind, step, inner) - 0.1 * step
        memory += grad**2
        step_memory += step_grad**2
        weights += 0.5 * grad / np.sqrt(memory)
        step += 0.05 * step_grad / np.sqrt(step_memory)
        bias += 0.5 * np.tanh(off.sum() / max(toxic.sum(), 1))
    model = Field({f: float(weights[place[i]]) for f, i in number.items() if weights[place[i]]}, float(bias), step, head)
    _, counts, p = model.marginals(texts)
    x = model.sums(counts, p)
    for _ in range(30):  # Newton steps for the document's logistic function
        q = 1 / (1 + np.exp(-np.clip(x @ model.head, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4)
        move = np.linalg.solve(hess, x.T @ (y - q) - 0.05 * model.head)
        model.head = model.head + np.clip(move, -2, 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, field_rows: int = FIELD_ROWS) -> Field:
    """The model from at most ``rows`` labelled documents in order of their keys' hashes, until they have ``chars`` characters.

    No document is left out for its length; one that reaches beyond ``chars`` is cut there.
    The field's steps and weights come from the first ``field_rows`` of either class.
    """
    sample = cut(labelled_sample(docs, labels, "toxic", remainder("doc_id", HELD_OUT) != 1, rows))
    order = (F.xxhash64("doc_id"), "doc_id")
    keys, held = [], 0
    for r in sample.select("doc_id", F.length("text").alias("n")).orderBy(*order).collect():
        if held >= chars:
            break
        keys.append(r["doc_id"])
        held += r["n"]
    got = sample.where(F.col("doc_id").isin(keys)).orderBy(*order).select(F.left("text", F.lit(chars)).alias("text"), "y").collect()
    return fit_field([r["text"] for r in got], np.array([float(r["y"] > 0) for r in got]), field_rows=field_rows)


def marked(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, score, spans) of every row; spans as start:end, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, found = shared.value.score(texts_of(batch))
        return pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array([",".join(f"{a}:{b}" for a, b in f) for f in found], pa.string())], ["doc_id", "score", "spans"])
    return arrow_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, score double, spans string")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return marked(docs, fit(docs, labels)).select("doc_id", (remainder("doc_id", HELD_OUT) == 1).alias("held_out"), "score",
                                                  (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
