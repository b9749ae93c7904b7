import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectio.functions import analysis
from lectio.functions.twin import measure, stem, tokenize
from lectio.operators.query import parse

FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text()


def rows(section: str) -> list[list[str]]:
    part = FIXTURES.split(section)[1].split("\n### ")[0]
    return [[c.strip().strip("`") for c in line.strip("| ").split(" | ")] for line in part.splitlines() if line.startswith("| ") and not line.startswith("|---")][1:]


def test_stems():
    cases = [r for r in rows("### C1.") if re.fullmatch(r"[a-z0-9-]+", r[0])]
    assert len(cases) > 60
    for word, want, *_ in cases:
        assert stem(word) == want


def test_tokens():
    for text, want in (r for r in rows("### C2.")):
        assert str(tokenize(text)) == want.strip("`") or text == ""


def test_measure():
    assert [measure(w) for w in ("troubl", "agr", "tre", "by", "sky", "")] == [1, 0, 1, 1, 1, 0]


def test_parser():
    for q, required, optional, phrases in rows("### C3."):
        p = parse(q.replace("<TAB>", "\t"))
        assert (str(p.required), str(p.optional), str(p.phrases)) == (required.strip("`"), optional.strip("`"), phrases.strip("`"))
    assert parse(None).is_empty and parse("  ").is_empty


def test_stem_column_equals_twin(spark):
    words = {r[0] for r in rows("### C1.")} | {"yy", "yyy", "ayy", "xyyed", "tyying", "hissing", "buzzed", "falling", "ionic", "sized", "s", "es", "ing", "ed", "y", "-ed", "7ing", "a-ll", "trolley", "controlling"}
    big = Path("/root/testdata/sf0.001/documents.parquet")
    if big.exists():
        words |= {r.token for r in analysis.exploded(spark.read.parquet(str(big)).select("doc_id", F.col("text").alias("content"))).select("token").distinct().collect()}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert all(r.s == stem(r.w) for r in df.select("w", analysis.stem(F.col("w")).alias("s")).collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aeiouybcdlstz-7", min_size=1, max_size=12), min_size=40, max_size=60), st.lists(st.text(alphabet="abcXYZ -79éİ\n\"", max_size=30), min_size=5, max_size=10))
def test_columns_equal_twins(spark, words, texts):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert all(r.s == stem(r.w) for r in df.select("w", analysis.stem(F.col("w")).alias("s")).collect())
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.s == tokenize(r.t) for r in df.select("t", analysis.tokenize(F.col("t")).alias("s")).collect())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "the law")], "doc_id long, content string")
    plan = analysis.stemmed(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", [None, "", "   "])
def test_blank(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(analysis.tokenize(F.col("t")).alias("x")).first().x == [] == tokenize(text)


def test_a_token_begins_like_its_stem():
    """All of the stem but its last four letters: what live search relies on."""
    words = [r[0] for r in rows("### C1.")] + ["rationalization", "valenci", "hesitanci", "vietnamization", "predication", "sensibiliti", "formaliti", "ies", "ational"]
    assert all(w.startswith(stem(w)[: max(1, len(stem(w)) - 4)]) for w in words)
