import math
from collections import defaultdict

import pytest

from lectio.llm import terms

SCHEMA = "term string, doc_id string, tf int, positions array<int>, mark string, records long"
ROWS = [
    ("a", "d1", 2, [0, 4], "x", 1), ("a", "d1", 2, [0, 4], "x", 1), ("a", "d2", None, [1, 2, 3], None, None), ("b", "d1", 5, None, None, None),
    ("b", "d1", 1, [9], None, None), ("", "d3", 4, [1], None, None), (None, "d4", 4, [1], None, None), ("c", None, 3, [1], None, None), ("  ", "d5", None, None, None, None),
    ("e", "d2", None, None, None, None), ("f", "d2", -3, None, None, None),
]


def brute(rows):
    docs, cf, df, tf = set(), defaultdict(int), defaultdict(set), defaultdict(int)
    for t, d, n, p in {(t, d, n, tuple(p) if p is not None else None) for t, d, n, p, *_ in rows}:
        if d is None:
            continue
        docs.add(d)
        if not t or not t.strip():
            continue
        o = max(0, n if n is not None else len(p) if p is not None else 0)
        cf[t] += o
        df[t].add(d)
        tf[t, d] += o
    return docs, cf, {t: len(x) for t, x in df.items()}, tf


def test_frequencies_and_marks(spark):
    _, cf, df, _ = brute(ROWS)
    got = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {t: (cf[t], df[t]) for t in df}
    marks = {r.term: r.mark for r in terms.mark_terms(spark.createDataFrame(ROWS, SCHEMA), rare_below=2, common_share=0.25).collect()}
    assert marks == {"a": "common", "b": "rare", "e": "rare", "f": "rare"}


def test_hot_term_is_counted_whole(spark):
    rows = [("hot", f"d{i % 700}", 1, [i], None, None) for i in range(2100)]
    got = terms.term_frequencies(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.occurrences, got.records) == (2100, 700)


def test_distinctiveness(spark):
    docs, cf, df, tf = brute(ROWS)
    n = len(docs)
    got = {(r.term, r.doc_id): r.score for r in terms.distinctiveness(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    for (t, d), f in tf.items():
        ridf = math.log2(n / df[t]) + math.log2(1 - math.exp(-cf[t] / n)) if cf[t] else 0.0
        assert got[t, d] == pytest.approx(f * ridf, abs=1e-6)


def test_ties_go_to_the_first_term(spark):
    rows = [("z", "d1", 2, [1, 2], None, None), ("y", "d1", 2, [3, 4], None, None), ("q", "d2", 1, [1], None, None)]
    got = {r.doc_id: r.term for r in terms.most_distinctive(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"d1": "y", "d2": "q"}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert terms.mark_terms(none).count() == 0 and terms.most_distinctive(none).count() == 0
