import math

import pytest
from pyspark.sql import functions as F

from lectio.api import SearchEngine
from lectio.functions.snippet import snippet
from lectio.functions.twin import tokenize
from lectio.operators import index, search
from lectio.operators.query import parse
from lectio.sources.store import IndexStore, read_legacy
from lectio.streaming import index as streaming

TEXTS = {
    1: "Natural law and the state. The law of nature is old.", 2: "Grace perfects nature; natural grace and law.", 3: "On virtue, reason and virtue.", 4: "", 5: "natural of the law",
    6: "reason and grace and grace and reason", 7: "The of and",
}


@pytest.fixture(scope="module")
def docs(spark):
    kinds = {1: "Pdf", 2: "Html", 5: "Html"}
    return spark.createDataFrame([(k, f"Title {k}", f"p/{k}", kinds.get(k, "Markdown"), v) for k, v in TEXTS.items()], "doc_id long, title string, path string, content_type string, content string").cache()


def brute(query: str) -> dict[int, float]:
    q = parse(query)
    tokens = {k: tokenize(v) for k, v in TEXTS.items()}
    n, avgdl = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for k, ts in tokens.items():
        if not any(t in ts for t in q.terms) or any(t not in ts for t in q.required):
            continue
        if any(not any(ts[i : i + len(p)] == p for i in range(len(ts))) for p in q.phrases):
            continue
        s = 0.0
        for t in q.terms:
            df = sum(t in x for x in tokens.values())
            tf = ts.count(t)
            if df and tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avgdl))
        out[k] = round(s, 6)
    return out


QUERIES = ["natural law", "law OR grace", "OR law grace", '"natural law"', '"natural law" grace', "grace grace reason", "zzzz", "law zzzz", "the of", '"law nature" "natural law"']


@pytest.mark.parametrize("query", QUERIES)
def test_search_against_brute_force(spark, docs, query):
    postings, lengths = index.build_postings(docs), index.doc_lengths(docs)
    got = {r.doc_id: r.score for r in search.scored(postings, lengths, index.corpus_stats(docs), parse(query)).collect()}
    assert got == pytest.approx(brute(query), abs=2e-6)


def test_batch_equals_single_searches(spark, docs):
    postings, lengths, stats = index.build_postings(docs), index.doc_lengths(docs), index.corpus_stats(docs)
    rows = search.batch(postings, lengths, stats, [(i, q, 3) for i, q in enumerate(QUERIES)]).collect()
    for i, q in enumerate(QUERIES):
        want = sorted(brute(q).items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(r.doc_id, pytest.approx(r.score, abs=2e-6)) for r in sorted((r for r in rows if r.qid == i), key=lambda r: r.rank)] == want


def test_plan(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.save({"docs": docs, "postings": index.build_postings(docs), "lengths": index.doc_lengths(docs), "stats": index.corpus_stats(docs)})
    held = store.load()
    ranked = search.scored(held["postings"], held["lengths"], held["stats"], parse("natural law"))
    plan = search.top(ranked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "TakeOrderedAndProject" in plan and "Python" not in plan
    assert "positions" not in plan  # not read without phrases


def test_invariants(spark, docs):
    postings, lengths = index.build_postings(docs), index.doc_lengths(docs)
    assert postings.agg(F.sum("tf")).first()[0] == lengths.agg(F.sum("doc_len")).first()[0]
    assert index.corpus_stats(docs).first().n == len(TEXTS)
    assert set(brute("natural law")) <= set(brute("natural OR law"))
    assert index.corpus_stats(docs.limit(0)).first().asDict() == {"n": 0, "avgdl": 0.0}


def test_upsert_and_delete(spark, docs):
    changes = spark.createDataFrame([(1, 1, "old"), (1, 2, "new text"), (9, 1, "more")], "doc_id long, seq int, content string")
    got = {r.doc_id: r.content for r in index.upsert_docs(docs, changes).collect()}
    assert got == {**TEXTS, 1: "new text", 9: "more"}
    assert {r.doc_id: r.title for r in index.upsert_docs(docs, changes.withColumn("title", F.lit("N"))).collect()}[1] == "N"
    postings = index.build_postings(docs)
    after = index.upsert_postings(postings, spark.createDataFrame([(1, "virtue")], "doc_id long, content string"))
    assert {r.term for r in after.where("doc_id = 1").collect()} == {"virtu"}
    assert index.delete_docs(postings, docs).count() == 0


def test_engine(spark, docs, tmp_path):
    path = str(tmp_path / "engine")
    with SearchEngine.create(spark, path) as e:
        e.index(docs)
        r = e.search("law OR grace", 2)
        assert r.total_matches == len(brute("law OR grace")) and r.items.count() == 2
        assert e.search("law", content_type="Html").total_matches == 2
        assert e.search("the").total_matches == 0 and e.search("law", 0).items.count() == 0
        assert [x["rank"] for x in e.search("law OR grace", 2, skip=2).items.collect()] == [3]
    again = SearchEngine.create(spark, path)
    item = again.search("virtue").items.first()
    assert item.title == "Title 3" and item.url == "p/3" and "<mark>virtue</mark>" in item.snippet and item.source_type == "Markdown"
    again.remove(docs.where("doc_id = 3"))
    assert again.search("virtue").total_matches == 0
    again.index(spark.createDataFrame([(3, "T", "law again", "x")], "doc_id long, title string, content string, extra string"))
    assert again.search("law").total_matches == 4


def test_stream_equals_batch(spark, docs, tmp_path):
    for i in range(2):
        docs.where(F.col("doc_id") % 2 == i).select("doc_id", "content", F.lit("upsert").alias("op"), F.lit(i).alias("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(6, "x", "remove", 9)], "doc_id long, content string, op string, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, content string, op string, seq int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = IndexStore(spark, str(tmp_path / "store"))
    streaming.start(stream, store, str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in store.load()["postings"].select("term", "doc_id", "tf").collect()}
    want = {tuple(r) for r in index.build_postings(docs.where("doc_id != 6")).select("term", F.col("doc_id").cast("string"), "tf").collect()}
    assert got == want and len(store._held()["segments"]) == 3
    assert store.stats() == pytest.approx((len(TEXTS) - 1, index.corpus_stats(docs.where("doc_id != 6")).first().avgdl))
    with SearchEngine.create(spark, store.path) as e:  # a stream into an engine's store, and back
        assert e.search("law").total_matches == 3
    changes = spark.createDataFrame([("1", "changed words", "New", "upsert", 1), ("2", None, None, "remove", 1)], "doc_id string, content string, title string, op string, seq int")
    streaming.apply_changes(store, changes)
    streaming.apply_changes(store, changes)
    e = SearchEngine.create(spark, store.path)
    assert e.search("changed").items.first().title == "New" and e.search("law").total_matches == 1 and e.numbers[0] == len(TEXTS) - 2
    store.compact()
    again = SearchEngine.create(spark, store.path)
    assert again.search("law").total_matches == 1 and again.numbers == e.numbers and again.docs.count() == len(TEXTS) - 2


def test_files_urls_and_older_indexes_are_searchable(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "essay.md").write_text("law and order")
    e = SearchEngine.create(spark)
    e.index_files(str(tmp_path / "f"))
    pages = spark.createDataFrame([("https://a.example/", "A", "the order of grace", True)], "url string, title string, text_content string, success boolean")
    assert e.index_url(pages, "https://a.example/") and not e.index_url(pages, "https://b.example/")
    for name, text in (("index", '{"law": [{"docId": "a", "termFrequency": 2, "positions": [3, 1]}]}'), ("documents", '{"a": {"Id": "a", "Title": "T", "Url": null, "ContentType": 1, "Path": "p"}}'), ("doc_lengths", '{"a": 5}'), ("doc_contents", '{"a": "law law"}')):
        assert not e.load_legacy(str(tmp_path))
        (tmp_path / f"{name}.json").write_text(text)
    assert e.load_legacy(str(tmp_path))
    assert {r.title for r in e.search("law").items.collect()} == {"essay", "T"} and {r.title for r in e.search("order").items.collect()} == {"essay", "A"}
    with pytest.raises(FileNotFoundError):
        e.index_files(str(tmp_path / "none"))


def test_one_id_twice_in_a_call_keeps_the_last(spark):
    e = SearchEngine.create(spark)
    e.index(spark.createDataFrame([("a", "old law"), ("a", "new law"), (None, "law")], "doc_id string, content string").coalesce(1))
    r = e.search("law")
    assert r.total_matches == 1 and "new" in r.items.first().snippet


def test_ranker_of_the_engine_holds_for_many_queries(spark, docs):
    e = SearchEngine.create(spark, k1=2.0, b=0.1)
    e.index(docs)
    one = [(r["rank"], r.score) for r in e.search("law OR grace", 3).items.collect()]
    many = sorted((r["rank"], r.score) for r in e.search_many([(1, "law OR grace", 3), (2, "the", 3)]).collect())
    assert one == many and one[0][1] != brute("law OR grace")[2]


def test_results_are_kept_until_a_change(spark, docs):
    e = SearchEngine.create(spark)
    e.index(docs)
    first = e.search(" LAW ")
    assert e.search("law") is first
    e.remove(docs.where("doc_id = 1"))
    assert e.search("law").total_matches == first.total_matches - 1
    assert e.search("zzzz").total_matches == 0 and e.search("zzzz").items.count() == 0
    e.clear()
    assert e.search("law").total_matches == 0


def test_another_analyzer(spark):
    from lectio.functions.analysis import Analyzer

    whole = Analyzer(lambda c: F.filter(F.split(F.lower(c), " "), lambda t: t != ""), lambda c: c, lambda q: q.lower().split())
    e = SearchEngine.create(spark, analyzer=whole)
    e.index(spark.createDataFrame([("a", "the laws"), ("b", "a law")], "doc_id string, content string"))
    assert e.search("the").total_matches == 1 and e.search("law").total_matches == 1


def test_a_save_follows_the_last_change(spark, docs, tmp_path):
    import time

    e = SearchEngine.create(spark, str(tmp_path / "late"), save_after=0.5)
    e.index(docs)
    assert e.store.current() is None
    for _ in range(100):
        if e.store.current():
            break
        time.sleep(0.3)
    assert IndexStore(spark, str(tmp_path / "late")).stats()[0] == len(TEXTS)


def test_a_search_reads_postings_only_and_looks_texts_up_by_id(spark, docs, tmp_path):
    with SearchEngine.create(spark, str(tmp_path / "plan")) as e:
        e.index(docs)
    e = SearchEngine.create(spark, str(tmp_path / "plan"))
    ranked = search.scored(e.postings, e.lengths, e.numbers, parse("natural law"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "/lengths" not in plan and "/docs" not in plan and plan.count("Scan parquet") == 1
    held = e.docs.where(F.col("doc_id").isin("1", "2"))
    assert "In(doc_id" in held._jdf.queryExecution().executedPlan().toString()


def test_legacy_files(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"law": [{"docId": "a", "termFrequency": 2, "positions": [3, 1]}]}')
    assert read_legacy(spark, str(tmp_path)) is None
    (tmp_path / "documents.json").write_text('{"a": {"Id": "a", "Title": "T", "Url": null, "ContentType": 1, "Path": "p"}}')
    (tmp_path / "doc_lengths.json").write_text('{"a": 5}')
    (tmp_path / "doc_contents.json").write_text('{"a": "law law"}')
    t = read_legacy(spark, str(tmp_path))
    assert t["postings"].first().positions == [1, 3] and t["docs"].first().content_type == "Markdown" and t["docs"].first().doc_id == "a" and t["lengths"].first().doc_len == 5


SNIPPETS = [
    ("The heart of Art and arts.", ["art"], "The he<mark>art</mark> of <mark>Art</mark> and <mark>arts</mark>."), ("Natural law theory", ["natur", "law"], "<mark>Natural</mark> <mark>law</mark> theory"),
    ("philosophy of mind", ["philosophi"], "philosophy of mind"), ("a<b>law & lawyer", ["law"], "a<b><mark>law</mark> & <mark>lawyer</mark>"),
    ("théologie Theology", ["th"], "<mark>théologie</mark> <mark>Theology</mark>"), ("", ["a"], ""), ("abc", [], "abc"), ("x" * 300, ["zz"], "x" * 280 + "..."),
]


def test_snippets(spark):
    for text, stems, want in SNIPPETS:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(snippet(F.col("t"), stems).alias("s")).first().s == want
    long = " ".join(f"w{i:03}" for i in range(200)) + " natural law " + " ".join(f"v{i:03}" for i in range(100))
    s = spark.createDataFrame([(long,)], "t string").select(snippet(F.col("t"), ["natur", "law"]).alias("s")).first().s
    assert s.startswith("...w153 w154 w") and s.endswith("<mark>natural</mark> <mark>law</mark> v000 v001 v002 v003 v004...")


def test_another_scorer_and_escaping(spark, docs):
    from lectio.functions.snippet import escaped

    e = SearchEngine.create(spark, scorer=lambda tf, df, dl, n, avgdl: tf)
    e.index(docs)
    got = {r.title: r.score for r in e.search("grace").items.collect()}
    assert got == {"Title 2": 2.0, "Title 6": 2.0}
    e.cancel()
    assert spark.createDataFrame([("<a & b>",)], "t string").select(escaped(F.col("t")).alias("x")).first().x == "&lt;a &amp; b&gt;"
