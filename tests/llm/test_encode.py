import pytest

from lectio.llm import encode

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "\n\n", "Hello  world", "l'été où naïve — “quoted” …", "日本語 🎉 mixed\x00text", "a" * 6000, "אבג " * 60, "x\r\n\r\ny\t z", "<|endoftext|> is text",
]


@pytest.fixture(scope="module")
def coder():
    return encode.Encoder(encode.build_model(encode.read_vocabulary(encode.default_vocabulary())), encode.default_pattern())


def test_equals_the_public_encoder_and_decodes_back(coder):
    ranks = {t: i for i, t in enumerate(encode.read_vocabulary(encode.default_vocabulary()))}
    other = tiktoken.Encoding("own", pat_str=encode.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS[1:]:
        ids = coder.encode(t)
        assert ids == other.encode_ordinary(t)
        assert coder.decode(ids) == t


def test_corpus(spark, coder):
    rows = [(i, t, [7], "x") for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, more string")
    out = encode.encode_corpus(df)
    assert out.columns == ["doc_id", "more", "ids"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.ids == coder.encode(TEXTS[r.doc_id]) for r in got)
    assert [r.ids for r in got if r.doc_id < 2] == [[]] * 4
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_memory_bound_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(encode, "MEMORY", 2)
    assert coder.decode(coder.encode("one two three four five six")) == "one two three four five six"
