import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def words(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "ing", "ti", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows, extra=False):
    """Documents from (doc_id, text) or (doc_id, text, lang); with columns that clash with results if asked."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    out = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        for c in ("score", "row", "key", "mark", "print", "spans", "label", "y", "chunk", "held", "quality_score", "lang_pred", "rank", "unit"):
            out = out.withColumn(c, F.lit("other"))
    return out


ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "x" * 3000 + " " + "long words " * 9000), (6, "日本語 🎉 é ß\x00\x1c z"), (7, "... !!! 123")]


@pytest.fixture(scope="session")
def llm(spark):
    from tidemark.llm.common import started
    return started(spark)
