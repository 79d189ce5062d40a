"""Chat formatting: round trips over hostile texts, digests by hand, the mask over the text."""
import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["[INST]", "[/INST]", "<INST]", "[/s>", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[\\INST]", "<\\\\/s>", "[", "<", "\\", "]", ">", "/", "INST]", "s>", " ", "\n", "\\n", "\\b", "a", "é", "🎉", "$1", "\x00"]
ROLES = ["user", "assistant", "system", "tool", "", None, "a\nb", "x\\n\\b", "[/ROLE]", "user\n", " user"]


def hostile(seed, n):
    r = random.Random(seed)
    return [(c, t, r.choice(ROLES), "".join(r.choice(BITS) for _ in range(r.randint(0, 12))) if r.random() > 0.1 else None) for c in range(n) for t in range(r.randint(1, 5))]


def by_hand(rows):
    """conv_id -> (n_turns, sha, chars, sha) straight from the source rows."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    out = {}
    for (_, _), group in groupby(sorted(rows, key=key), key):
        group = list(group)
        turns = sorted(((t is not None, t or 0, role or "", text or "") for _, t, role, text in group))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learnt = "".join(text for _, _, role, text in turns if role == "assistant")
        out[group[0][0]] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


ODD = [(None, None, None, None), (None, 1, "user", "x"), (9001, None, "assistant", "late"), (9001, 0, "assistant", None), (9002, 0, "user", "same"), (9002, 0, "user", "same"),
       (9002, 0, "assistant", "same"), (9003, 5, "assistant", "long <s> " * 60_000)]


@pytest.fixture(scope="module")
def rows():
    return hostile(3, 400) + ODD


def test_digests_by_hand(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for c in ("formatted", "turns", "row", "loss", "escaped"):
        frame = frame.withColumn(c, F.lit("other"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.query(frame).collect()}
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert got == by_hand(rows + probe)


def test_marks_never_stand_in_bodies_and_masks_fit(spark, rows):
    source = by_hand(rows)
    for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect():
        text, runs = r["formatted"], r["loss_runs"]
        marks = sum(text.count(m) for pair in [*chat.MARKS.values(), chat.OTHER] for m in pair)
        assert marks == 2 * source[r["conv_id"]][0] == 2 * len(runs)
        assert sum(x for run in runs for x in run) == len(text)
        at, held = 0, []
        for run in runs:
            held.append(text[at + run["skip"]:at + run["skip"] + run["learn"]])
            at += sum(run)
        assert all(not (b.startswith("<s>") or b.endswith("</s>")) for b in held)
        if not r["escaped"]:
            assert len("".join(held)) == source[r["conv_id"]][2]


def test_recovered_turns(spark):
    rows = [(1, 0, "user", "[INST] a [/INST]"), (1, 1, "assistant", "b\\"), (2, 0, "tool\n", "<s>")]
    back = [tuple(r) for r in chat.recovered(chat.formatted(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "turn").collect()]
    assert back == rows


@pytest.mark.parametrize("text", ["", "x", "[INST] a", "[INST] a [/INST] ", "[INST] a </s>", "[INST]a[/INST]", " [INST] a [/INST]", "<s> a </s>b<s> c </s>", "<s> a [INST] </s>"])
def test_other_texts_are_refused(spark, text):
    assert spark.range(1).select(chat.parse(chat.turn_texts(F.lit(text))).alias("turns")).first()["turns"] is None


def test_empty_table_and_plan(spark):
    assert [r["conv_id"] for r in chat.query(spark.createDataFrame([], SCHEMA)).collect()] == [-1]
    plan = chat.query(spark.range(3).select(F.col("id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
