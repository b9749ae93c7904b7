import random

import pytest

from lectio.llm import truncation as T

NOUNS = "law grace reason duty truth mercy faith hope order vow prayer belief custom wisdom nature symbol".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} orders the {rng.choice(NOUNS)} and the {rng.choice(NOUNS)} in {rng.choice('ABCDEF')}{rng.choice(NOUNS)}."


def essay(rng, n=30):
    return "On Duty and Law\n" + " ".join(sentence(rng) for _ in range(n))


CLOSED = [
    "He spoke.", "Is it so?", "“So it is!”", "a sentence of the law. (Duty Tract, bk. 7, ch. 40)", "Text here.\n\n[1] Ulréll, Original Rite, p. 392", "Text here.\nKeywords: law; grace; common duty",
    "Text here.\nFalinburg, 3 May 1736", "Text here.\nBrother Faquist Ysmalvík, Dorskebrook", "Text here.\nFINIS", "Text here.\nExplicit liber", "Text here.\n* * *", "Text here.\n— 30 —", "Text here.\n[End of the text]",
    "Text here.\nAmen", "The law holds.\nChoose the best answer:",
]
CUT = [
    "A text. Under the older custom, the grace of", "A text. What requires the disputed perf", "A text. The law of the (more)", "A text. The law [...]", "A text. The law… Read more", "A text. The law…[cut]", "A text. The law... »",
    "A text. Since law, as duty,", "A text. The law of r�", "A text.\n\nNeither form without silence in the", "A text. The law of...",
]


def test_closes_and_random_places_part_by_their_terminality(spark):
    """Texts of a corpus whose ends are of all complete forms, and some cut: the ratios learnt from it decide."""
    rng = random.Random(3)
    rows = [essay(rng, 6) + ("" if k % 3 else " " + rng.choice(CLOSED)) for k in range(400)]
    cut = [t[: rng.randrange(200, 260)].rstrip(" .") for t in (essay(rng, 6) for _ in range(40))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows + cut)], "doc_id long, text string, source string")
    got = {r.doc_id: r.why for r in T.judge(df).where("cut").collect()}
    assert set(got.values()) == {"word"} and len(set(got) & set(range(400, 440))) >= 36 and len(set(got) - set(range(400, 440))) <= 2


@pytest.mark.parametrize("text", CLOSED)
def test_complete_forms_are_terminal_before_anything_is_counted(text):
    assert T.Terminality.prior(*T.closing(T.without_marker(text))[:2]) >= 1.0


@pytest.mark.parametrize("text", CUT)
def test_open_sentences_are_not(text):
    bare = T.without_marker(text)
    assert T.Terminality.prior(*T.closing(bare)[:2]) <= 0.1 or bare != text


def test_shapes():
    assert T.closing("Text.\n- law before grace\n- duty before hope")[1] == T.ITEM
    assert T.closing("Text.\nand law orders the grace of Paris\nand hope orders the duty of Rome")[1] == T.VERSE
    assert T.closing("Text.\n- law before grace\n- duty be")[1] == T.SHORT_ITEM
    assert T.closing("First line.\n" + "word " * 3000 + "the")[1] == T.PROSE  # a last line of any length is read whole
    assert T.without_marker("The law… [continued]") == "The law… "


def test_terminality_learns_closing_words():
    cells = {(T.BARE, T.ITEM, 5): (300, 4), (T.BARE, T.ITEM, 0): (3, 90), (T.STOP, T.PROSE, 5): (600, 30), (T.BARE, T.PROSE, 2): (60, 839)}
    told = T.Terminality(cells)
    assert set(told.cut()) == {(T.BARE, T.ITEM, 0), (T.BARE, T.PROSE, 2)} and 0.03 < told.share < 0.12


def test_copies_cut_to_any_part_are_found(spark):
    """Recall of the near-copy step alone, against brute force, for copies cut to 3/4 down to 1/16 with changed words."""
    rng = random.Random(9)
    essay = lambda n: " ".join(" ".join(f"{rng.choice(NOUNS)}{rng.randrange(99)}" for _ in range(9)) + "." for _ in range(n))
    rows, cut = [], {}
    for k in range(240):
        full, part = essay(50), [0.75, 0.5, 0.25, 1 / 16][k % 4]
        words = full[: full.index(".", int(len(full) * part)) + 1].split(" ")
        for at in range(len(words)):
            if rng.random() < 0.02:
                words[at] = "changed"
        rows += [(2 * k, full), (2 * k + 1, " ".join(words))]
        cut[2 * k + 1] = T.relation(" ".join(words), full) == T.ENDS_EARLY
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id for r in T.judge(df).where("why = 'copy'").collect()}
    true = {i for i, c in cut.items() if c}
    assert not got - true and len(true) > 200 and len(got & true) >= 0.95 * len(true)


def test_table(spark):
    rng = random.Random(4)
    whole = [essay(rng) for _ in range(60)]
    rows = [(i, t, f"s{i % 3}", "x") for i, t in enumerate(whole)]
    full = essay(rng, 40)
    at = full.index(".", int(len(full) * 0.9)) + 1
    early = full[:at]  # ends with a full stop; only its longer copy shows it
    rows += [(100, full, "s0", None), (101, early, "s1", None), (102, early, None, None), (103, full, "s0", None)]
    rows += [(200, whole[0][:300] + " the", "s2", None), (201, None, "s2", None), (202, "", "s2", None), (203, " \n ", None, None), (204, "word", "s2", None), (None, "A text of the", None, None)]
    rows += [(205, "- law before grace\n" * 40_000 + "- law before qqqq", "s2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut string")
    got = {r.doc_id: r.why for r in T.judge(df).where("cut").collect()}
    assert got[101] == got[102] == "copy" and 200 in got and got[None] == "word"
    assert not {100, 103, 201, 202, 203, *range(60)} & set(got)
    shares = {r.source: (r.texts, r["cut"]) for r in T.cut_by_source(df).collect()}
    assert shares["s1"] == (21, 1)
    assert T.find_cut(df.limit(0)).count() == 0


def test_alignment_needs_a_longer_copy():
    rng = random.Random(5)
    t = essay(rng, 20)
    assert T.relation(t, t) == T.SAME_END and T.relation(t, essay(rng, 40)) == T.UNRELATED and T.relation(t[:-200], t) == T.ENDS_EARLY


def test_every_longer_copy_is_met(spark):
    rng = random.Random(6)
    essay = lambda rng, n: " ".join(" ".join(f"{rng.choice(NOUNS)}{rng.randrange(99)}" for _ in range(9)) + "." for _ in range(n))
    rows, cut = [], []
    for k in range(12):  # copies cut to a third: few minima of the whole are those of the part
        full = essay(rng, 60)
        part = full[: full.index(".", len(full) // 3) + 1]
        rows += [(2 * k, full), (2 * k + 1, part)]
        cut.append(2 * k + 1)
    full = essay(rng, 44)
    part = full[: full.index(".", len(full) * 9 // 10) + 1]
    rows += [(100, full), (101, part)]  # anthologies that end with the part are longer than its whole copy
    rows += [(200 + k, essay(rng, 12) + " " + part) for k in range(30)]
    got = {r.doc_id: r.why for r in T.judge(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")).where("cut").collect()}
    assert got == dict.fromkeys([*cut, 101], "copy")
