import random
from collections import defaultdict

from lectio.llm import lines as L
from lectio.llm import pages, spam

SCHEMA = "page_id long, url string, title string, text_content string, out_links array<string>, success boolean, error string, line_no int, site string"
rng = random.Random(2)
N = "law grace reason duty truth mercy faith hope order vow prayer belief custom wisdom nature symbol".split()


def para():
    return " ".join(f"The {rng.choice(N)} of {rng.choice(N)}, as {rng.choice(N)}, orders the {rng.choice(N)} in this {rng.choice(N)} and not in that." for _ in range(3))


def title(i):
    return f"On {N[i % 16].capitalize()}{chr(97 + i % 26)} and {N[i // 3 % 16].capitalize()}{chr(97 + i // 26)}"


def page(i, host, standing=True, body=None):
    top = ["Accept all cookies", f"Seen {i * 7} times on {i % 28 + 1} March 20{i % 20 + 10}"] if standing else []
    end = [f"HOUSE OF {host.upper()}" if i % 2 else f"House of {host}", "ÉDITÉ · maison"] if standing else []
    mid = body if body is not None else [title(i), para(), "Next: On Grace »", para(), f"and {rng.choice(N)} orders the {rng.choice(N)} {rng.choice(N)} of {title(i)[3:]}"]
    return (i, f"https://www.{host}/p/{i}", title(i), "\r\n".join([*top, "", *mid, *end]), [], True, None, 3, "x")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((r.page_id, r.line_no) for r in df.collect())


def test_standing_lines_against_brute_force(spark):
    rows = [page(i, "a.example") for i in range(12)] + [page(100 + i, "b.example") for i in range(7)]
    rows += [(500, None, None, "Accept all cookies", None, None, None, None, None), (501, "https://a.example/x", None, None, None, None, None, None, None), (502, "nonsense", "t", "", None, None, None, None, None)]
    got = rows_of(pages.standing_lines(table(spark, rows)))
    groups = defaultdict(set)
    where = {}
    for r in rows:
        if r[1] and "a.example" in r[1] and r[3]:
            for i, line in enumerate(r[3].split("\n")):
                if line.strip():
                    k = L.skeleton(line.rstrip("\r"))
                    groups[k].add(r[0])
                    where[r[0], i] = k
    want = sorted(p for p, k in where.items() if len(groups[k]) >= 8)
    assert got == want and len(got) >= 12 * 4


def test_a_garbled_copy_counts_as_what_it_was(spark):
    rows = [page(i, "a.example", False, ["Mentions légales — Répertoire é", para()]) for i in range(8)]
    bad = "Mentions légales — Répertoire é".encode().decode("cp437")
    rows[7] = (*rows[7][:3], bad + "\n" + para(), *rows[7][4:])
    assert rows_of(pages.standing_lines(table(spark, rows)))[-1][0] == 7


def test_near_lines_join_by_hashing(spark):
    base = "About the house of this name: the law of grace and the order of reason rule here as they have done for many hundred years and will"
    rows = [page(i, "a.example", False, [base + (" always" if i % 2 else " ever") + " do so among us all in this quiet place of prayer and of work, where each guest who comes in peace may read the old books of the hall by the light of day", para()]) for i in range(10)]
    got = rows_of(pages.standing_lines(table(spark, rows)))
    assert [p for p, _ in got] == list(range(10))


def test_residue_and_spam_pages_are_neither_counted_nor_listed(spark):
    rows = [page(i, "a.example") for i in range(7)] + [page(7, "a.example", True, ["{{page.title}}"])]
    rows += [page(8, "a.example", True, ["buy rosary beads Paris", "cheap rosary beads Rome", "best wedding ring Bonn", "free rosary beads Kiel", "discount rosary beads Paris"] * 4)]
    df = table(spark, rows)
    assert rows_of(pages.standing_lines(df)) == []
    assert [r.page_id for r in pages.keyword_pages(df).collect()] == [8]


def test_spam_lines():
    def share(text):
        ls = text.split("\n")
        c = spam.spam_words(ls, [L.normal(x) for x in ls])
        return sum(s for _, s in c) / sum(n for n, _ in c)

    assert share("[cheap wedding ring] [buy wedding ring] [best wedding ring] [new wedding ring]\n" * 5) == 1
    assert share("Our official crucifix is the official crucifix that Paris trusts for official crucifix. Visit Rome for official crucifix, crucifix and more official crucifix. " * 4) > 0.9
    assert share("#cheapstudybible #newstudybible #beststudybible\nhttp://cheap-ring.example/1 http://x.example/2") == 1
    assert share("cheap holy water font Paris 153.63 Add to cart\nnew relic frame Rome 12.10 SKU 7001") == 1
    assert share("\n".join(f"{a.capitalize()} of {b.capitalize()}, pray for us." for a in N for b in N[:3])) == 0
    assert share("\n".join(f"Kedor Ketesras, The Lawful {a.capitalize()}, Ulilgrave 1742, 180 pp." for a in N)) == 0
    assert share("Baptism calls to baptism, and baptism answers baptism, as the monk doubts. So baptism returns to baptism in the end. " * 3) < 0.5
    assert share(" ".join(para() for _ in range(5))) == 0


def test_body(spark):
    rows = [page(i, "a.example") for i in range(9)]
    got = defaultdict(set)
    for r in pages.outside_body(table(spark, rows)).collect():
        got[r.page_id].add(r.line_no)
    for r in rows:
        ls = [x.strip() for x in r[3].split("\n")]
        out = {i for i, x in enumerate(ls) if x.startswith(("Accept", "Seen", "Next", "House", "HOUSE", "ÉDIT"))}
        assert got[r[0]] == out, r[0]


def test_body_of_odd_pages(spark):
    rows = [
        (1, "https://s.example/1", None, "Home\nContact\nAbout us", None, None, None, None, None),
        (2, "https://s.example/2", "T", "T\n" + para(), None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "https://s.example/4", "", para() + "\n" + "x" * 500_000, None, None, None, None, None),
        (5, "https://s.example/5", "T", "Слово и закон\n日本語の文章です", None, None, None, None, None),
    ]
    got = rows_of(pages.outside_body(table(spark, rows)))
    assert (1, 0) in got and not [p for p, _ in got if p in (2, 4, 5)]
    none = table(spark, rows).limit(0)
    assert pages.outside_body(none).count() == 0 and pages.standing_lines(none).count() == 0 and pages.keyword_pages(none).count() == 0


def test_texts_without_standing_lines(spark):
    df = table(spark, [page(i, "a.example") for i in range(8)])
    got = {r.page_id: r.text for r in pages.without_standing_lines(df).collect()}
    assert len(got) == 8 and all("cookies" not in t and "On " in t for t in got.values())


def test_texts_of_bodies(spark):
    rows = [page(i, "a.example") for i in range(8)] + [(90, "https://a.example/n", None, None, None, None, None, None, None)]
    got = {r.page_id: r.text for r in pages.body(table(spark, rows)).collect()}
    assert got[90] is None and all(got[i].startswith("On ") or got[i].startswith("\r\nOn ") for i in range(8)) and not any("Next" in (t or "") for t in got.values())


def test_near_lines_have_the_recall_of_brute_force(spark):
    """Pairs of lines of one site at a similarity of 0.8 or more, by hashing and by comparing all."""
    import random

    from pyspark.sql import functions as F

    from lectio.llm import garble

    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    lines = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(90, 140))]
        for _ in range(4):
            words = list(base)
            for at in rng.sample(range(len(words)), 1):
                words[at] = rng.choice(vocabulary)
            lines.append(" ".join(words))
    rows = [page(i, "a.example", False, [x]) for i, x in enumerate(lines)]
    df = table(spark, rows)
    signer = pages._Signer()
    owner, shingle = signer.shingles(lines)
    sets = [set(shingle[owner == i].tolist()) for i in range(len(lines))]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    model = garble.PairModel.fit(df, ["title", "text_content"])
    got = pages.line_table(df, model)
    counts = got.groupBy("site", "skeleton").agg(F.count("*").alias("pages"), F.first("sig1").alias("sig1"), F.first("sig2").alias("sig2"), F.min(F.struct("page_id", "line_no")).alias("at"))
    label = {r.page_id: r.cluster for r in got.join(pages.near_lines(counts, df, model), ["site", "skeleton"]).select("page_id", "cluster").collect()}
    met = [label.get(i) is not None and label.get(i) == label.get(j) for i, j in near]
    assert len(near) > 100 and sum(met) >= 0.95 * len(near)


def test_names_are_passing_details_of_sentences_only():
    signer = pages._Signer()
    same = lambda a, b: signer.shingles([a])[1].tolist() == signer.shingles([b])[1].tolist()
    assert same("This page was last read by Anna Holm on 3 May 2020.", "This page was last read by Otto Berg on 11 June 1999.")
    assert not same("On the grace and the law of hope by Anna Holm", "On the grace and the law of hope by Otto Berg")
    assert same("Printed on 3 March 2020", "Printed on 11 June 1999") and not same("http://a-shop1.example/1", "http://b-shop1.example/1")
    assert len(signer.shingles(["one", "", "слово"])[1]) == 2 and not same("слово", "дело")


def test_long_lines_keep_their_weight():
    long = [(0, 0, 90_000, 5000.5, 0.0), (1, 4, 9, 0.0, 1.0), (2, 0, 30, 6.0, 0.0)]
    assert pages.body_outside(long) == [1]
