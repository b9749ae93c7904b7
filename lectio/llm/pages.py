"""The three page problems that work on lines: standing lines of a site (1), spam pages (4), and body extraction (7).

One map over the pages writes a narrow table of lines (:func:`line_table`): identifiers, the hash of the line's skeleton,
its kind, word counts and a MinHash signature, but no text. It is written once to the shared folder, so that the later
joins and counts read a few columns of it instead of the texts. All later steps are joins and aggregates on hashes.

Common rules: null, empty and blank texts have no lines; a page without a host in its url belongs to no site, so none of
its lines stands; repeated page_ids are judged as rows of one page; further columns are ignored; an empty table gives an
empty result. Sites and skeletons are 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import garble, residue, spam
from . import lines as L
from .tables import components, sifted, written

#: Pages of a site that a line must be on to be a standing line of it.
STANDING = 8
#: Sites that a short line must be on to be furniture everywhere.
EVERYWHERE = 8
#: Share of the words (without furniture) that must be spam.
SPAM_SHARE, SPAM_WORDS = 0.5, 12
#: Pages that a worker handles at once; it bounds memory, not results.
PART = 1000
#: Words of a shingle, hashes of a signature (four bands of two: lines at similarity 0.8 meet with probability 0.98), and
#: the share of shingles that near copies have in common at least.
SHINGLE, HASHES, SIMILAR = 5, 8, 0.8

_LINES = (
    "page_id long, site long, line_no int, skeleton long, first boolean, kind byte, words int, points float, spam int, "
    "page_spam long, page_words long, out_links int, residue boolean, sig1 long, sig2 long"
)


class _Signer:
    """MinHash signatures of lines on word shingles, with numbers, dates and names masked, for a whole batch at once.

    Names (words with a capital, but the first) are masked where the line is a sentence: it ends with a mark and has SHINGLE
    words in small letters, and as many of them as names. There a name is a passing detail; in titles, links and by-lines it
    is what the line says. Masks that follow each other are one. A line of fewer words than a shingle is one shingle.
    """

    NUMBER, NAME, PAD = 1, 2, 3

    def __init__(self):
        import numpy as np
        import xxhash

        self.np, self.hash = np, xxhash.xxh64_intdigest
        rng = np.random.default_rng(20240101)
        self.a = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.codes: dict[str, int] = {}

    def _word(self, w: str) -> int:
        code = self.codes.get(w)
        if code is None:
            if len(self.codes) > 500_000:
                self.codes.clear()
            low = w.lower()
            plain = _DIGITS.sub("#", "".join(c for c in low if c.isascii() and c.isalnum()))
            if plain in _MONTHS and (plain not in ("may", "mar") or w[:1].isupper()) or "#" in plain and _ORDINAL.fullmatch(plain):
                code = self.NUMBER
            else:  # the lowest bits tell a capital and a small letter
                code = self.hash(plain or low) & ~15 | 8 | w[:1].isupper() << 1 | w[:1].islower()
            self.codes[w] = code
        return code

    def shingles(self, lines: list[str]) -> tuple:
        """(owner, shingle): the hashed shingles of each line, by line. Words are split and numbered natively; only distinct
        words are hashed here."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = pc.utf8_trim_whitespace(pa.array([x.lower() if x.isupper() else x for x in lines], pa.string()))
        lists = pc.utf8_split_whitespace(text)
        lengths = np.where(np.asarray(pc.utf8_length(text)) > 0, np.asarray(pc.list_value_length(lists)), 0)
        flat = lists.flatten()
        flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        if not len(flat):
            return none
        tokens = np.array([self._word(w) for w in flat.dictionary.to_pylist()], np.uint64)[np.asarray(flat.indices)]
        line_of = np.repeat(np.arange(len(lines)), lengths)
        word = tokens >= 8
        name = word & (tokens & np.uint64(2) > 0)
        name[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        small = np.bincount(line_of, weights=word & (tokens & np.uint64(1) > 0), minlength=len(lines))
        names = np.bincount(line_of, weights=name, minlength=len(lines))
        sentence = np.asarray(pc.match_substring_regex(text, "[.!?:;…]$"))
        passing = name & (sentence & (small >= SHINGLE) & (small >= names))[line_of]
        tokens = np.where(passing, np.uint64(self.NAME), np.where(word, tokens & np.uint64(0xFFFFFFFFFFFFFFF0) | np.uint64(8), tokens))
        again = np.zeros(len(tokens), bool)
        again[1:] = (tokens[1:] == tokens[:-1]) & (tokens[1:] < 8) & (line_of[1:] == line_of[:-1])
        tokens, line_of = tokens[~again], line_of[~again]
        count = np.bincount(line_of, minlength=len(lines))
        room = np.where(count > 0, np.maximum(count, SHINGLE), 0)
        place = np.arange(len(tokens)) + np.repeat(np.cumsum(room) - room - (np.cumsum(count) - count), count)
        filled = np.full(int(room.sum()), self.PAD, np.uint64)
        filled[place] = tokens
        line_of = np.repeat(np.arange(len(lines)), room)
        n = len(filled) - SHINGLE + 1
        with np.errstate(over="ignore"):
            shingle = np.zeros(n, np.uint64)
            for j in range(SHINGLE):
                shingle = (shingle ^ filled[j : j + n]) * self.mix[j]
                shingle ^= shingle >> np.uint64(29)
        whole = line_of[:n] == line_of[SHINGLE - 1 :]
        return line_of[:n][whole], shingle[whole]

    def sign(self, lines: list[str]) -> tuple:
        """Two 64-bit words of four 16-bit minima for each line, and whether it has a signature (all but empty ones)."""
        np = self.np
        s1, s2, ok = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)
        owner, shingle = self.shingles(lines)
        if not len(owner):
            return s1, s2, ok
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        rows = owner[starts]
        with np.errstate(over="ignore"):
            minima = [np.minimum.reduceat((shingle * self.a[k] + self.b[k]) >> np.uint64(32), starts) & np.uint64(0xFFFF) for k in range(HASHES)]
        pack = lambda m: (m[0] | m[1] << np.uint64(16) | m[2] << np.uint64(32) | m[3] << np.uint64(48)).astype(np.int64)
        s1[rows], s2[rows], ok[rows] = pack(minima[:4]), pack(minima[4:]), True
        return s1, s2, ok


_DIGITS = re.compile(r"\d+")
_ORDINAL = re.compile(r"(?:#(?:st|nd|rd|th|er|de|e|h|am|pm)?)+")
_MONTHS = frozenset(L.MONTHS)


def line_table(pages: DataFrame, model: garble.PairModel) -> DataFrame:
    """One narrow row for each non-blank line of ``pages`` (page_id, url, title, text_content). Garbled text is restored
    before lines are compared. Written to the shared folder; no shuffle."""
    slim = pages.select("page_id", F.xxhash64(L.site_of(F.col("url"))).alias("site"), L.site_of(F.col("url")).isNotNull().alias("hosted"), "title", "text_content", F.size(F.coalesce("out_links", F.array().cast("array<string>"))).alias("out_links"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        repair = shared.value.repair
        signer = _Signer()
        for batch in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            ids, sites, hosted, titles, texts, linked = (c.to_pylist() for c in batch.columns)
            of_page: list[tuple] = []
            counted: list[int] = []
            numbers, keys, firsts, kinds, words, points, spams, raw = [], [], [], [], [], [], [], []
            for page, site, host, title, text, out in zip(ids, sites, hosted, titles, texts, linked):
                if not text or text.isspace():
                    continue
                held = residue.residue(text) is not None
                text, _ = repair(text)
                title = L.normal(repair(title)[0]) if title else ""
                numbered = L.site_lines(text)
                norms = L.normals(text)
                mine = [norms[i] for i, _ in numbered]
                bare = [line for _, line in numbered]
                counts = spam.spam_words(bare, mine)
                seen = set()
                for line, norm in zip(bare, mine):
                    key = digest(L.skeleton(line, norm))
                    keys.append(key)
                    firsts.append(key not in seen)
                    seen.add(key)
                    k = L.kind(line, norm, title)
                    kinds.append(k)
                    points.append(1.0 + line.count(",") + min(len(line) / 100, 3.0) if k <= L.LIST and len(norm) > 20 else 0.0)
                    raw.append(line)
                numbers += [i for i, _ in numbered]
                words += [n for n, _ in counts]
                spams += [n for _, n in counts]
                of_page.append((page, site if host else None, sum(n for _, n in counts), sum(n for n, _ in counts), out, held))
                counted.append(len(numbered))
            if not keys:
                continue
            s1, s2, ok = signer.sign(raw)
            rows = pa.array(np.repeat(np.arange(len(counted)), counted))
            c = list(zip(*of_page))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c[0], pa.int64()).take(rows),
                    pa.array(c[1], pa.int64()).take(rows),
                    pa.array(numbers, pa.int32()),
                    pa.array(np.array(keys, np.uint64).astype(np.int64)),
                    pa.array(firsts, pa.bool_()),
                    pa.array(kinds, pa.int8()),
                    pa.array(words, pa.int32()),
                    pa.array(points, pa.float32()),
                    pa.array(spams, pa.int32()),
                    *(pa.array(x, k).take(rows) for x, k in zip(c[2:], (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))),
                    pa.array(s1, mask=~ok),
                    pa.array(s2, mask=~ok),
                ],
                [f.split()[0] for f in _LINES.split(", ")],
            )

    return written(slim.mapInArrow(run, _LINES))


def line_groups(table: DataFrame, pages: DataFrame, model: garble.PairModel) -> DataFrame:
    """(site, skeleton, cluster): lines that may stand, each with the cluster it counts for.

    Lines of one skeleton are copies: one of them stands for all. The skeletons of a site are clustered by
    locality-sensitive hashing (four bands of two minima); the similarity of each pair is then verified on its shingles,
    and clusters are the connected components. A skeleton without near copies is a cluster of its own.
    """
    counts = written(
        table.where("first and not residue and site is not null")
        .groupBy("site", "skeleton")
        .agg(F.count("*").alias("pages"), F.first("sig1").alias("sig1"), F.first("sig2").alias("sig2"), F.min(F.struct("page_id", "line_no")).alias("at"))
    )
    near = near_lines(counts, pages, model)
    alone = counts.where(F.col("pages") >= STANDING).select("site", "skeleton", F.col("skeleton").alias("cluster")).join(near, ["site", "skeleton"], "left_anti")
    return near.unionByName(alone)


#: Lines of a bucket that the others are laid beside in the first round, and how many times as many in each further one.
FIRST, FURTHER = 1, 64


def near_lines(counts: DataFrame, pages: DataFrame, model: garble.PairModel) -> DataFrame:
    """(site, skeleton, cluster) of the lines of ``counts`` (site, skeleton, pages, sig1, sig2, at) with near copies on their
    site. In each bucket the lines are laid beside its most frequent one, then beside the next ones, to the last, but for
    pairs that are of one component already; so a bucket of one family takes one round."""
    bits = (F.shiftrightunsigned(F.col(s), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)) for s in ("sig1", "sig2") for half in (0, 1))
    bands = counts.where("sig1 is not null").select("site", "skeleton", "pages", "at", F.posexplode(F.array(*bits)).alias("band", "value"))
    bucket = ["site", "band", "value"]
    shared = bands.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").select(*bucket)
    members = bands.join(shared, bucket, "left_semi")
    enough = members.select("site", "skeleton", "pages").distinct().groupBy("site").agg(F.sum("pages").alias("all")).where(F.col("all") >= STANDING)
    order = Window.partitionBy(*bucket).orderBy(F.desc("pages"), "skeleton")
    members = written(members.join(enough.select("site"), "site", "left_semi").withColumn("place", F.row_number().over(order)))
    shingles = written(_shingles_of(members.select("site", "skeleton", "at.page_id", "at.line_no").distinct(), pages, model))
    most, before = FIRST, 0
    edges = labels = None
    last = members.agg(F.max("place")).first()[0] or 0
    while before < last:
        top = members.where(F.col("place").between(before + 1, most)).select(*bucket, F.col("skeleton").alias("other"), F.col("place").alias("at_place"))
        pairs = members.join(top, bucket).where("place > at_place").select("site", "skeleton", "other").distinct()
        if labels is not None:
            pairs = (
                pairs.join(labels, ["site", "skeleton"], "left")
                .join(labels.select("site", F.col("skeleton").alias("other"), F.col("label").alias("label2")), ["site", "other"], "left")
                .where("label is null or label2 is null or label != label2")
                .select("site", "skeleton", "other")
            )
        both = pairs.join(shingles, ["site", "skeleton"]).join(shingles.select("site", F.col("skeleton").alias("other"), F.col("shingles").alias("theirs")), ["site", "other"])
        common = F.size(F.array_intersect("shingles", "theirs"))
        found = written(both.where(common >= SIMILAR * (F.size("shingles") + F.size("theirs") - common)).select("site", "skeleton", "other"))
        edges = found if edges is None else edges.union(found)
        labels = components(edges, "site", "skeleton", "other")
        before, most = most, most * FURTHER
    if labels is None:
        return counts.select("site", "skeleton", F.col("skeleton").alias("cluster")).limit(0)
    return labels.withColumnRenamed("label", "cluster")


def _shingles_of(lines: DataFrame, pages: DataFrame, model: garble.PairModel) -> DataFrame:
    """(site, skeleton, shingles): the distinct shingles of each of ``lines`` (site, skeleton, page_id, line_no). Only the
    pages that hold one are read on."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    of = lines.groupBy("page_id").agg(F.collect_list(F.struct("site", "skeleton", "line_no")).alias("lines"))
    held = sifted(pages.select("page_id", "text_content"), "page_id", of.select("page_id")).join(of, "page_id").select("text_content", "lines")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        signer = _Signer()
        repair = shared.value.repair
        for batch in batches:
            texts, sites, skeletons = [], [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                held = dict(L.site_lines(repair(text)[0]))
                mine = [x for x in wanted if x["line_no"] in held]
                texts += [held[x["line_no"]] for x in mine]
                sites += [x["site"] for x in mine]
                skeletons += [x["skeleton"] for x in mine]
            owner, shingle = signer.shingles(texts)
            if not len(owner):
                continue
            key = np.unique(np.stack([owner.astype(np.uint64), shingle]), axis=1)
            offsets = np.searchsorted(key[0], np.arange(len(texts) + 1, dtype=np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sites, pa.int64()), pa.array(skeletons, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[1].astype(np.int64)))],
                ["site", "skeleton", "shingles"],
            )

    # a page_id of several rows may hold other lines at these numbers: the largest set is taken
    rows = held.mapInArrow(run, "site long, skeleton long, shingles array<long>")
    return rows.groupBy("site", "skeleton").agg(F.max_by("shingles", F.size("shingles")).alias("shingles"))


def _on_enough_pages(rows: DataFrame) -> DataFrame:
    """The (site, cluster) of ``rows`` that are on at least STANDING pages: pages are made distinct first, so that the
    count of a hot line is spread over tasks and added."""
    return rows.select("site", "cluster", "page_id").distinct().groupBy("site", "cluster").agg(F.count("*").alias("pages")).where(F.col("pages") >= STANDING)


#: Words of a page for each of its links up to which its links count as many.
WORDS_A_LINK = 8


def spam_pages(table: DataFrame, standing: DataFrame) -> DataFrame:
    """(page_id) of spam: pages whose lines, apart from standing lines and furniture, are mostly spam words; and pages with
    a link for WORDS_A_LINK words or fewer, whose own lines are mostly no sentences and not more than the links. Only pages
    with enough spam words or links at all are looked at."""
    many = ~F.col("residue") & (F.col("out_links") * WORDS_A_LINK >= F.col("page_words"))
    some = table.where((F.col("page_spam") >= SPAM_WORDS) | many).select("page_id", "site", "skeleton", "kind", "words", "spam", "out_links", many.alias("many"))
    own = some.join(standing.select("site", "skeleton"), ["site", "skeleton"], "left_anti")
    judged = ~F.col("kind").isin(*L.FURNITURE) | (F.col("spam") > 0)
    listed = F.col("kind").isin(L.SHORT, L.LINK, L.PATH)
    sums = own.groupBy("page_id").agg(
        F.sum(F.when(judged, F.col("words")).otherwise(0)).alias("words"),
        F.sum("spam").alias("spam"),
        F.sum("words").alias("all"),
        F.sum(F.when(listed, F.col("words")).otherwise(0)).alias("listed"),
        F.count_if(listed).alias("lines"),
        F.max("many").alias("many"),
        F.max("out_links").alias("out_links"),
    )
    stuffed = (F.col("spam") >= SPAM_WORDS) & (F.col("spam") >= SPAM_SHARE * F.col("words"))
    list_of_links = F.col("many") & (F.col("lines") >= SPAM_WORDS) & (F.col("lines") <= F.col("out_links")) & (F.col("listed") >= SPAM_SHARE * F.col("all"))
    return sums.where(stuffed | list_of_links).select("page_id")


class Site:
    """What the line table says, computed once: standing lines, spam pages and the remaining good pages' lines."""

    def __init__(self, pages: DataFrame):
        model = garble.PairModel.fit(pages, ["title", "text_content"])
        self.table = line_table(pages, model)
        self.groups = written(line_groups(self.table, pages, model))
        counted = self.table.where("not residue").select("page_id", "site", "skeleton").join(self.groups, ["site", "skeleton"])
        first = _on_enough_pages(counted)
        self.spam = written(spam_pages(self.table, self.groups.join(first, ["site", "cluster"], "left_semi")))
        self.good = self.table.where("not residue").join(self.spam, "page_id", "left_anti")

    def standing_lines(self) -> DataFrame:
        """(page_id, line_no, site, skeleton) of each standing line on each good page."""
        rows = self.good.select("page_id", "line_no", "site", "skeleton").join(self.groups, ["site", "skeleton"])
        return rows.join(_on_enough_pages(rows), ["site", "cluster"], "left_semi").select("page_id", "line_no", "site", "skeleton")

    def standing_skeletons(self) -> DataFrame:
        """(site, skeleton) of the standing lines over the good pages."""
        rows = self.good.select("page_id", "site", "skeleton").join(self.groups, ["site", "skeleton"])
        return self.groups.join(_on_enough_pages(rows), ["site", "cluster"], "left_semi").select("site", "skeleton")


def standing_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines that stand on at least STANDING pages of their site."""
    return Site(pages).standing_lines().select("page_id", "line_no")


def keyword_pages(pages: DataFrame) -> DataFrame:
    """(page_id) of keyword-stuffed and link-list pages."""
    return Site(pages).spam


def drop_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, text): each page's text without the lines (page_id, line_no); a page of which none are named keeps its
    text, null stays null. The numbers of a page are gathered (at most its lines) and joined; texts move once."""
    drop = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    joined = pages.select("page_id", "text_content").join(drop, "page_id", "left")
    kept = F.filter(F.split("text_content", "\n"), lambda x, i: ~F.array_contains("drop", i))
    return joined.select("page_id", F.when(F.col("drop").isNull(), F.col("text_content")).otherwise(F.array_join(kept, "\n")).alias("text"))


def without_standing_lines(pages: DataFrame) -> DataFrame:
    """(page_id, text): each page's text without its site's standing lines."""
    return drop_lines(pages, standing_lines(pages))


def body(pages: DataFrame) -> DataFrame:
    """(page_id, text): the article of each page alone; pages that are spam or residue keep their text, as
    :func:`outside_body` names none of their lines."""
    return drop_lines(pages, outside_body(pages))


#: Words of a short line found on many sites that make it a link of every page.
FEW = 6
#: A block scores as part of the body from this share of the best one's points.
SIBLING = 0.02


def outside_body(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the non-blank lines outside the main body of each page that is neither spam nor residue.

    A page is read as a tree of blocks of lines (:func:`body_outside`). Each line brings points for its length and commas
    and its link density: 1 for lines that lead elsewhere or serve the page (standing lines of the site, short lines found
    on many sites, and links, paths, legal and cookie notices by their form), else 0.
    """
    site = Site(pages)
    everywhere = (
        site.table.where(F.col("first") & (F.col("words") <= FEW) & F.col("kind").isin(L.SHORT, *L.FURNITURE))
        .select("skeleton", "site")
        .distinct()
        .groupBy("skeleton")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= EVERYWHERE)
        .select("skeleton", F.lit(True).alias("everywhere"))
    )
    linked = (
        F.coalesce("standing", F.lit(False))
        | F.col("kind").isin(*L.FURNITURE)
        | (F.coalesce("everywhere", F.lit(False)) & (F.col("words") <= FEW) & (F.col("kind") == L.SHORT))
    )
    leaves = (
        site.good.select("page_id", "line_no", "site", "skeleton", "kind", "words", "points")
        .join(site.standing_skeletons().withColumn("standing", F.lit(True)), ["site", "skeleton"], "left")
        .join(everywhere, "skeleton", "left")
        .select("page_id", F.struct("line_no", "kind", "words", "points", linked.alias("linked")).alias("line"))
    )
    by_page = leaves.groupBy("page_id").agg(F.collect_list("line").alias("lines"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            line = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(ends))
            order = np.lexsort((np.asarray(line.field("line_no")), owner))
            columns = [line.field(name).take(pa.array(order)).to_pylist() for name in ("line_no", "kind", "words", "points", "linked")]
            ids, nos = [], []
            for page, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                outside = body_outside(list(zip(*(c[a:b] for c in columns))))
                ids += [page] * len(outside)
                nos += outside
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], ["page_id", "line_no"])

    return by_page.mapInArrow(run, "page_id long, line_no int").distinct()


def body_outside(lines: list[tuple]) -> list[int]:
    """Numbers of the lines outside the body, from (number, kind, words, points, link density) in order of number.

    Leaves pass their points, discounted by their link density, to their block; a leaf of links alone passes nothing and
    ends the block. A block's points are discounted by the link density of its container, that is of the block with the
    links on both its sides. The best block is the body, with those siblings whose points reach SIBLING of it and what
    lies between them, and with headings, lists and verses beside them.
    """
    blocks: list[list[tuple]] = []
    links = [0]  # words of links before the first block, between blocks, and after the last
    open_block = False
    for line in lines:
        if line[4] >= 0.5:
            links[-1] += line[2]
            open_block = False
            continue
        if not open_block:
            blocks.append([])
            links.append(0)
            open_block = True
        blocks[-1].append(line)
    outside = [line[0] for line in lines if line[4] >= 0.5]
    if not blocks:
        return outside
    score = []
    for i, block in enumerate(blocks):
        own = sum(x[2] for x in block)
        beside = (links[i] + links[i + 1]) / 2
        score.append(sum(x[3] * (1 - x[4]) for x in block) * own / max(own + beside, 1))
    best = max(range(len(blocks)), key=lambda i: score[i])
    if score[best] <= 0:  # no paragraph anywhere: the longest block of lines is the body
        best = max(range(len(blocks)), key=lambda i: sum(x[2] for x in blocks[i]))
        keep = [i == best or any(x[1] in (L.TITLE, L.LIST) for x in b) for i, b in enumerate(blocks)]
    else:
        scoring = [i for i, s in enumerate(score) if s > SIBLING * score[best]]
        low, high = scoring[0], scoring[-1]
        keep = []
        for i, b in enumerate(blocks):
            inner = low <= i <= high
            headed = any(x[1] in (L.TITLE, L.LIST) for x in b) or i == low - 1 and any(x[2] >= 3 for x in b)
            verses = i > high and all(x[2] >= 5 for x in b)
            keep.append(inner or headed or verses)
    for b, k in zip(blocks, keep):
        if not k:
            outside += [x[0] for x in b]
    return sorted(outside)
