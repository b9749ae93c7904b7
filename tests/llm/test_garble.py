import random

import pytest

from lectio.llm import garble

CLEAN = [
    "La vérité précède l'espérance; le désir caché règle la pauvreté près de Brecorvallée.", "Die Größe des Geistes öffnet die Lehre während der Fastenzeit für Müller.",
    "El corazón del niño completa la razón más allá del síntoma; según la opinión común.", "The abbot’s sermon—never printed—was “plain” and “lawful” at Monñez’s house · © 2020.",
]
MEANT = [
    "The word ἀρετή is left untranslated.", "Слово и закон стоят рядом в списке.", "NÃO HÁ COMPREENSÃO SEM COMPAIXÃO", "ÂME · ÊTRE · ÔTER in capitals", "He sets √2 beside the sign ≠ and £3 or 40 ¢",
    "חסד ואמת stand together",
]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, "Une vérité cachée", rng.choice(CLEAN) + " " + rng.choice(CLEAN)) for i in range(600)]
    rows += [(1000 + i, None, m) for i, m in enumerate(MEANT * 3)]
    return garble.PairModel.fit(spark.createDataFrame(rows, "page_id long, title string, text_content string"), ["title", "text_content"])


@pytest.mark.parametrize("wrong", ["cp1252", "cp437", "mac_roman", "cp1251", "cp1250"])
def test_utf8_read_as(model, wrong):
    for text in CLEAN:
        data = text.encode("utf-8")
        try:
            bad = data.decode(wrong)
        except UnicodeDecodeError:
            bad = garble_cp1252(data) if wrong == "cp1252" else None
        if bad is None:
            continue
        restored, found = model.repair(bad)
        assert found and restored == text


def garble_cp1252(data: bytes) -> str:
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


def test_twice_and_in_capitals(model):
    text = CLEAN[0]
    twice = garble_cp1252(garble_cp1252(text.encode()).encode())
    assert model.repair(twice) == (text, True)
    restored, found = model.repair("la vérité · " + garble_cp1252("le désir".encode()).upper())
    assert found


@pytest.mark.parametrize("wrong", ["mac_roman", "cp437", "cp1251"])
def test_single_byte(model, wrong):
    text = CLEAN[2]
    assert model.repair(text.encode("cp1252").decode(wrong)) == (text, True)


def test_meant_text_stays(model):
    for text in [*CLEAN, *MEANT]:
        assert model.repair(text) == (text, False)


def test_lost_characters(model):
    text, found = model.repair("la v�rit�")
    assert found and text == "la v�rit�"
    assert model.repair(None) == (None, False) and model.repair("") == ("", False) and model.repair("plain") == ("plain", False)


def test_table(spark):
    rows = [(i, "vérité", CLEAN[i % 4], "kept") for i in range(200)] + [(900, None, "", None), (901, "vÃ©ritÃ©", None, None), (902, "ok", "la v�rit� " + CLEAN[0] * 100, None)]
    df = spark.createDataFrame(rows, "page_id long, title string, text_content string, field string")
    got = {(r.page_id, r.field): r.restored for r in garble.find_garbled(df).collect()}
    assert set(got) == {(901, "title"), (902, "text_content")} and got[901, "title"] == "vérité"
    assert garble.find_garbled(df.limit(0)).count() == 0
    both = garble.repair_columns(df.withColumnRenamed("field", "title_garbled"), ["title"])
    assert both.where("page_id = 901").first().title == "vérité" and both.where("title_garbled").count() == 1


def test_the_pair_table_is_bounded():
    assert len(garble.ALPHABET) < 700
    assert {garble.fold(chr(c)) for c in range(0x4E00, 0x9FFF)} <= {chr(c << 12 | 0xFFF) for c in range(4, 10)}


def test_very_long_values(model):
    long = (CLEAN[0] + "\n") * 20_000
    assert model.repair(long) == (long, False)
    assert model.repair(long + garble_cp1252("né".encode()))[1]
