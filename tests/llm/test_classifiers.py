"""Quality, language and toxicity: held-out accuracy, plain versions of the models, odd rows."""
import math
import random
import zlib

import numpy as np
import pytest
from conftest import ODD, frame, words
from pyspark.sql import functions as F

from tidemark.llm import language, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


@pytest.fixture(scope="module")
def corpus(llm):
    """Plain documents, repeated junk (quality 0) and documents with one of three toxic stems."""
    r, rows, labels = random.Random(3), [], []
    for i in range(900):
        text = words(i, r.randint(20, 80))
        junk, bad = i % 6 == 0, i % 5 == 1
        if junk:
            text = " ".join([text.split()[0]] * 40).upper() + "!!"
        if bad:
            parts = text.split()
            parts.insert(r.randrange(len(parts)), r.choice(["zorgq", "vilex", "mukka"]) + r.choice(["", "ab", "ter"]))
            text = " ".join(parts)
        rows.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    return frame(llm, rows), llm.createDataFrame(labels, LABELS)


def test_trees_walk_like_a_plain_tree():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    forest = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=15)

    def plain(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + (row[forest.feature[node]] > forest.limit[node])
            total += forest.value[node]
        return total
    assert np.allclose(forest.margin(x), [plain(row) for row in x])
    assert ((forest.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.95


def test_statistics_of_a_batch_equal_those_of_each_text():
    texts = [t or "" for _, t in ODD] + [words(i, 30) for i in range(20)]
    assert np.allclose(quality.statistics(texts), np.concatenate([quality.statistics([t]) for t in texts]))


def test_quality_held_out(corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in quality.query(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == 900 and all(r["held_out"] == held(i, 5, 0) for i, r in got.items())
    assert np.mean([r["predicted"] == truth[i] for i, r in got.items() if r["held_out"]]) > 0.97


def test_toxicity_held_out_and_spans(corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    truth, texts = {r["doc_id"]: r["toxic"] for r in labels.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["held_out"] == held(i, 3, 1) for i, r in got.items())
    assert np.mean([r["predicted"] == truth[i] for i, r in got.items() if r["held_out"]]) > 0.97
    for i, r in got.items():
        for span in filter(None, r["spans"].split(",")):
            a, b = map(int, span.split(":"))
            assert texts[i][a:b].lower()[:5] in ("zorgq", "vilex", "mukka")


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 333):
        emission, fresh, step = r.normal(0, 2, n), r.random(n) < 0.2, r.normal(0, 1, (2, 2))
        fresh[0] = True
        got, ahead, behind = toxicity.forward_backward(emission, fresh, step)
        want = []
        starts = [*np.flatnonzero(fresh), n]
        for a, b in zip(starts, starts[1:]):
            own = np.exp(np.stack([np.zeros(b - a), emission[a:b]], 1))
            up, down = own.copy(), np.ones_like(own)
            for t in range(1, b - a):
                up[t] = up[t - 1] @ np.exp(step) * own[t]
            for t in range(b - a - 2, -1, -1):
                down[t] = np.exp(step) @ (own[t + 1] * down[t + 1])
            want += list((up * down)[:, 1] / (up * down).sum(1))
        assert np.allclose(got, want)


def test_code_lengths_are_those_of_a_plain_coder():
    texts = {"a": ["the cat sat on the mat", "that thin cat"], "b": ["der hund und die katze", "die hunde"]}
    coder = language.build(texts, order=2)

    def plain(name, text):
        data = [t.encode() for t in texts[name]]

        def counts(context):
            out = {}
            for d in data:
                d = b"\0\0" + d
                for i in range(2, len(d)):
                    if d[i - len(context):i] == context:
                        out[d[i]] = out.get(d[i], 0) + 1
            return out

        def probability(context, s):
            if context is None:
                return None
            seen = counts(context)
            n, d = sum(seen.values()), len(seen)
            if not context:
                return seen[s] / n * n / (n + d) if s in seen else d / (n + d) / (256 - d)
            if not seen:
                return probability(context[1:], s)
            if s in seen:
                return seen[s] / (n + d)
            return d / (n + d) * probability(context[1:], s) / (1 - sum(probability(context[1:], u) for u in seen))
        padded = b"\0\0" + text.encode()
        return -sum(math.log2(probability(padded[i - 2:i], padded[i])) for i in range(2, len(padded)))
    probe = ["the hund", "xyz", "", "that katze mat"]
    got = coder.bits([p.encode() for p in probe])
    for i, p in enumerate(probe):
        assert got[i] == pytest.approx([plain("a", p), plain("b", p)], rel=1e-4)
    assert np.allclose(got, np.concatenate([coder.bits([p.encode()]) for p in probe]), rtol=1e-5)


def test_language_held_out(llm):
    syllables = {"xa": ["pla", "tro", "min"], "xb": ["schu", "gen", "ver"], "xc": ["qui", "eau", "ment"]}
    r, rows = random.Random(5), []
    for i in range(600):
        name = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choice(syllables[name]) for _ in range(3)) for _ in range(12)), name))
    got = {r["doc_id"]: r for r in language.query(frame(llm, rows)).collect()}
    assert all(r["held_out"] == held(i, 5, 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(got[i]["lang_pred"] == name for i, _, name in rows if got[i]["held_out"])


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(llm, corpus, extra):
    docs, labels = frame(llm, ODD, extra), corpus[1]
    for out in (quality.query(docs, labels), toxicity.query(docs, labels), language.query(docs)):
        rows = out.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language.query(docs).where("doc_id in (1, 2, 3, 7)").collect()} == {"und"}
    empty = labels.where("false")
    assert {r["score"] for r in quality.query(docs, empty).collect()} == {0.5}
    assert len(toxicity.query(docs, empty).collect()) == len(ODD)
    nothing = docs.where("false")
    for out in (quality.query(nothing, labels), toxicity.query(nothing, empty), language.query(nothing)):
        assert out.count() == 0
    kept = quality.kept(docs, quality.fit(docs, empty), 0.4)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert language.kept(docs, language.fit(docs)).columns == docs.columns


def test_null_labels_are_not_learnt(llm, corpus):
    docs, labels = corpus
    odd = labels.union(llm.createDataFrame([(None, 0, 1), (5, None, None), (10**9, 0, 1)], LABELS))
    a = quality.query(docs, labels).orderBy("doc_id").select(F.round("score", 9)).collect()
    assert a == quality.query(docs, odd).orderBy("doc_id").select(F.round("score", 9)).collect()


def test_languages_with_only_long_or_null_texts(llm):
    long = "zug quark jodel " * 2000
    rows = [(i, words(i, 40), "en") for i in range(30)] + [(100 + i, long, "de") for i in range(10)] + [(200 + i, None, "fr") for i in range(10)] + [(300, "quark zug jodel zug", None)]
    model = language.fit(frame(llm, rows))
    assert model.names == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.query(frame(llm, rows, True)).collect()}
    assert len(got) == len(rows) and got[300] == "de" and got[0] == "en" and got[200] == "und"
    few = language.fit(frame(llm, [(1, words(i, 5), "en") for i in range(40)]), rows=1)  # one key, of which a share is drawn
    assert few.names == ["en"] and few.best(["there"])[0] == ["en"]


def test_short_clean_documents_are_kept(llm):
    rows = [(i, words(i // 4, 40), f"l{i % 4}") for i in range(120)] + [(200 + i, "the", None) for i in range(3)] + [(300, "12", None)]
    docs = frame(llm, rows)
    model = language.fit(docs)
    assert 0 < model.best(["the"])[1][0] < 0.5
    assert {r["doc_id"] for r in language.kept(docs, model).collect()} == {r[0] for r in rows} - {300}


def test_toxicity_learns_from_long_texts_alone(llm):
    r, rows, labels = random.Random(4), [], []
    for i in range(140):
        text = words(i, 4500) + (" zorgq" * 3 if i % 2 else "")
        rows.append((i, text))
        labels.append((i, 1, i % 2))
    assert min(len(t) for _, t in rows) > 20_000
    docs = frame(llm, [*rows, *((1000 + i, words(i, 30) + (" zorgq " if i % 2 else "") + words(i + 99, 30)) for i in range(20))])
    labels = llm.createDataFrame(labels, LABELS)
    score = {x["doc_id"]: x["score"] for x in toxicity.query(docs, labels).collect()}
    assert min(score[i] for i in score if i % 2) > max(score[i] for i in score if not i % 2)
    short = toxicity.fit(docs, labels, chars=30_000)  # the second document is cut, none is left out
    assert len(short.head) == 4


def test_fractions_and_raised_digits_are_no_letters():
    assert not any(map(language.lettered, ["", "½ ½", "²³ ¼", "12 _ .", "\n"])) and all(map(language.lettered, ["½ a", "日", "ª"]))


def test_a_text_of_fractions_has_no_language(llm):
    docs = frame(llm, [*((i, words(i, 20), "en") for i in range(20)), (99, "½ ½", "en")])
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.query(docs).collect()}[99] == ("und", 0.0)
