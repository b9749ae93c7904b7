import random

import pytest

from lectio.llm import leaks

WORDS = [f"w{a}{b}" for a in "bcdfghklmnp" for b in "aeiou"]


def passage(rng, n):
    return [rng.choice(WORDS) + rng.choice("xyz") for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    items = {i: passage(rng, 60) for i in range(20)}
    fill = lambda n: passage(rng, n)
    changed = list(items[3][:30])
    changed[9] = "changed"
    changed[20] = "other"
    docs = {
        1: fill(200),
        2: fill(50) + items[1] + fill(40),
        3: fill(90) + items[2][10:30] + fill(30),
        4: fill(20) + changed + fill(20),
        5: fill(30) + items[4][:12] + fill(60) + items[4][40:52] + fill(5),
        6: fill(40) + items[5][:8] + fill(40),
        7: fill(40) + items[6][:10] + fill(10),
        8: items[7] + items[8],
        9: fill(3000) + items[9][:25] + fill(3000),
    }
    want = {(2, 1), (3, 2), (4, 3), (5, 4), (8, 7), (8, 8), (9, 9)}
    rows = [(k, " ".join(v).capitalize() + ".", 5) for k, v in docs.items()] + [(10, None, 1), (11, "", 1), (12, "  ", 1), (2, " ".join(docs[2]), 5)]
    evals = [(k, " ".join(v)) for k, v in items.items()] + [(90, None), (91, ""), (92, "short item")]
    return rows, evals, want


def tables(spark, case):
    rows, evals, want = case
    return spark.createDataFrame(rows, "doc_id long, text string, item_id long"), spark.createDataFrame(evals, "item_id long, text string"), want


def test_leaks(spark, case):
    docs, items, want = tables(spark, case)
    got = leaks.find_leaks(docs, items).select("doc_id", "item_id").distinct().collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_the_join_for_large_item_sets_gives_the_same(spark, case, monkeypatch):
    docs, items, want = tables(spark, case)
    monkeypatch.setattr(leaks, "SENT_BYTES", 10)
    got = leaks.find_leaks(docs, items).select("doc_id", "item_id").distinct().collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_alignment():
    item = list(range(40))
    assert leaks.align(item, [99] * 5 + item[:20] + [99] * 5, [6]) == (20, 1)
    assert leaks.align(item, item[:8] + [99] * 30, [0]) == (0, 0)
    two = item[:12] + [77] * 50 + item[20:32]
    assert leaks.align(item, two, [0, 65]) == (24, 2)


def test_ids_of_text(spark, case):
    docs, items, want = tables(spark, case)
    got = leaks.find_leaks(docs, items.selectExpr("concat('i', item_id) AS item_id", "text")).select("doc_id", "item_id").distinct().collect()
    assert {(r.doc_id, int(r.item_id[1:])) for r in got} == want


def test_masks_are_spaced_and_hit_ten_equal_words():
    assert all(m[-1] > len(m) - 1 for m in leaks.MASKS)
    assert sum(9 - m[-1] for m in leaks.MASKS) >= leaks.HITS
