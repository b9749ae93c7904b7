"""Texts cut off before their end (problem 10).

* Near copies: a copy that was cut is a *prefix* of the whole, so MinHash banding works on prefixes. Each text signs its
  first 6, 12, 24, ... five-word shingles; a cut text meets the longer ones in the bands of its own longest signed prefix,
  which covers at least half of it, however much of the whole is gone. The pair is aligned by words, and the copy whose
  alignment ends early is cut (:func:`relation`).
* The rest is scored by the terminality of its close (:class:`Terminality`): how often the closing word closes a sentence
  or line in the whole corpus, with the mark after it and the shape of the last line. The score of such a close is the
  ratio of how often texts of the corpus end so to how often the same texts, cut at a random place, would. A text that
  closes as random places do, and as ends hardly do, is cut.
* A mark that says that the text goes on elsewhere ("[...]", "Read more") is taken off first; where the rest has a terminal
  close, the mark alone tells the cut (sign ``mark``).

Null, empty and blank texts are no cases. Copies of a cut text are cut too. Empty tables give empty results; ties of
length go to the greater hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import sifted, written

SHINGLE, SIMILAR = 5, 0.8
#: Bands of minima that each signed prefix has: a pair of prefixes at similarity 0.8 meets with probability 0.994, at 0.67
#: (a text with 0.8 of its shingles in the other and as many of its own) with 0.95.
BANDS, ROWS = 5, 2
#: Shingles of the shortest signed prefix; each further one has twice as many.
LEAST = 6
#: Each further round meets so many times as many longer texts.
FURTHER = 8
#: Words by which the longer copy must go on after the alignment.
EARLY = 4
#: A close that is at an end at most so many times as often as at a random place tells a cut (see :class:`Terminality`).
RATIO = 0.3
#: Weight of the wider class in the ratio of a narrower one, in observations.
WEIGHT = 6.0

_WORD = re.compile(r"[^\W_]+")
_MARKER = re.compile(
    r"(?i)(?:\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\)|…|\.{3,}|(?:…|\.{2,})\s*[»›>]+|\[(?:cut|truncated|continued|more|snip)\]|\((?:more|continued|cont\.?|suite|weiter|m.s)\)|"
    r"(?:…|\.{2,})?\s*\b(?:read more|continue reading|lire la suite|weiterlesen|mehr lesen|leer m.s|seguir leyendo|to be continued)\b\W*)$|�$"
)
_FINIS = re.compile(
    r"(?i)^\W*(?:finis|fin|ende|the end|end|explicit(?: liber)?|amen|laus deo|\[?\s*end of (?:the )?\w+\s*\]?|-?\s*30\s*-?|#+|\*(?:\s*\*)*|—\s*\d+\s*—)\W*$"
)
_STOP = re.compile(r"[.!?][\"'”’»›)\]]*$|[”»›]$")
_REFERENCE = re.compile(r"^\W*(?:\[\d+\]|\d+[.)]|[*†‡])\s.*\b(?:pp?|s|bd|bk|ch|vol|no|cf)\.\s*\d+|^\(.*\)$|\([^()]{2,100}\d\)$|\bpp?\. ?\d+\W*$")
_KEYWORDS = re.compile(r"(?i)^(?:key ?words?|tags|topics|mots[ -]cl.s|schlagw.rter|stichworte|palabras clave)\s*[:—-]")
_DATE = re.compile(r"(?:^|\s)(?:\d{1,2}\.? ?(?:de )?[^\W\d_]{3,12}\.? (?:de )?\d{3,4}|[^\W\d_]{3,12} \d{1,2}, \d{4}|\d{4}-\d\d-\d\d|[MDCLXVI]{3,})\W*$")
_ITEM = re.compile(r"^\s*(?:[-*–•·]|\d{1,3}[.)]|\([a-z0-9]{1,3}\)|[a-z]\))\s+\S")
_CLOSING = re.compile(r"(?<!\w)([^\W_]++)[^\w.!?\r\n]*+[.!?\r\n]")
_PARTICLES = frozenset("of de von van der den the la le du di da y et and zu zur brother sister father mother fr sr".split())

#: Marks after the closing word.
STOP, PAUSE, BARE = range(3)
#: Shapes of the closing line.
FINIS, REFERENCE, KEYWORDS, DATE, LEAD, NAME, TITLE, ITEM, SHORT_ITEM, VERSE, PROSE = range(11)
#: Kinds of closing words by their form: small, capital, number, none.
SMALL, CAPITAL, NUMBER, NONE = range(4)
#: What the ratio of a mark and shape is taken for before anything is counted.
PRIOR = {PAUSE: 0.1, BARE: 0.1}
PRIOR_SHAPE = {FINIS: 4.0, REFERENCE: 4.0, KEYWORDS: 4.0, DATE: 4.0, LEAD: 4.0, NAME: 4.0, TITLE: 1.0, ITEM: 1.0, VERSE: 1.0}


def closing(text: str) -> tuple[int, int, str]:
    """(mark, shape, closing word) of a text: the mark after its last word, and the shape of its last line beside the
    lines before it."""
    lines = _last_lines(text)
    last = lines[-1]
    found = _WORD.findall(last)
    mark = STOP if _STOP.search(last) else PAUSE if last[-1] in ",;:-–—(«“„‘&/" else BARE
    return mark, _shape(last, lines, mark), found[-1] if found else ""


def _shape(last: str, lines: list[str], mark: int) -> int:
    if _FINIS.search(last):
        return FINIS
    if mark == STOP:
        return PROSE
    for pattern, shape in ((_REFERENCE, REFERENCE), (_KEYWORDS, KEYWORDS), (_DATE, DATE)):
        if pattern.search(last):
            return shape
    n = len(last.split())
    if last[-1] == ":" and n <= 8:  # an instruction or heading on its own line
        return LEAD
    names = [w for w in last.split() if w[:1].isalpha()]
    if n <= 8 and names and "," in last and len(lines) > 1 and all(w[0].isupper() or w.lower() in _PARTICLES for w in names):
        return NAME
    if len(lines) == 1:
        return TITLE if n <= 15 and sum(w[0].isupper() for w in names) * 2 > len(names) else PROSE
    if _ITEM.search(last):
        before = [x for x in lines[:-1] if _ITEM.search(x)]
        return ITEM if not before or n >= min(len(x.split()) for x in before) else SHORT_ITEM
    if last[0].islower() and n <= 14 and not _STOP.search(lines[-2]) or _verse(lines):
        return VERSE
    return PROSE


def _last_lines(text: str, most: int = 4) -> list[str]:
    """The last non-blank lines, however long, without the spaces around them."""
    end, out = len(text), []
    while end > 0 and len(out) < most:
        at = max(text.rfind("\n", 0, end), text.rfind("\r", 0, end))
        line = text[at + 1 : end].strip()
        if line:
            out.append(line)
        end = at
    return out[::-1]


def _verse(lines: list[str]) -> bool:
    """Whether the last lines are short, without full stops and of like length."""
    tail = lines[-3:]
    return len(tail) >= 2 and all(len(x.split()) <= 12 and not _STOP.search(x) for x in tail) and len(tail[-1].split()) >= min(len(x.split()) for x in tail[:-1])


def cut_at_random(text: str, seed: int) -> str | None:
    """``text`` cut between 0.3 and 0.95 of its length at a place that ``seed`` says, at any character or, for every
    second seed, after a word; null for a text of under 40 characters."""
    n = len(text)
    if n < 40:
        return None
    at = int(n * (0.3 + 0.65 * (seed >> 1 & 0xFFFF) / 0x10000))
    if seed & 1:
        space = text.find(" ", at)
        at = space if space > 0 else at
    part = text[:at]
    return None if not part or part.isspace() else part


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Distinct words of a worker's counts that are added up before they are handed on; it bounds memory, not results.
COUNTED = 1_000_000


def features(documents: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """One narrow row a text: id, source, hash, word count with and without a closing mark of an excerpt, its close and
    that of the same text cut at random, and the band keys of its prefixes; and, with ``vocab`` set, rows of (text_hash =
    word code, n = occurrences, bare = times it closes a sentence or line), added per worker. Written to the shared
    folder."""
    slim = documents.select(doc, source, text)
    kinds = [f"`{doc}` {slim.schema[doc].dataType.simpleString()}", f"`{source}` {slim.schema[source].dataType.simpleString()}"]
    fields = "text_hash long, n long, bare long, marked boolean, mark int, shape int, kind int, code long, at_mark int, at_shape int, at_kind int, at_code long, keys array<long>, vocab boolean"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        rng = np.random.default_rng(7)
        mix, a = (rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (SHINGLE, BANDS * ROWS))
        code = _Codes(digest)
        counted = _Counts()
        schema = None

        def close(t: str | None) -> tuple:
            if not t or t.isspace():
                return None, None, None, None
            mark, shape, w = closing(t)
            kind = NONE if not w else NUMBER if w[0].isdigit() else CAPITAL if w[0].isupper() else SMALL
            c = code[w.lower()]
            return mark, shape, kind, c - (1 << 64) if c >> 63 else c

        for batch in batches:
            schema = batch.schema
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows, flat, ends, counts = [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    if not t or t.isspace():
                        continue
                    low = t.lower()
                    ws = _WORD.findall(low)
                    bare = without_marker(t)
                    kept = len(ws) if bare is t else len(_WORD.findall(bare.lower()))
                    if len(code) > COUNTED:
                        code.clear()
                    flat += map(code.__getitem__, ws)
                    ends += map(code.__getitem__, _CLOSING.findall(low))
                    h = digest(t)
                    counts.append(len(ws))
                    rows.append((i, h - (1 << 64) if h >> 63 else h, len(ws), kept, bare is not t, *close(bare), *close(cut_at_random(t, h))))
                if not rows:
                    continue
                tokens = np.array(flat, np.uint64)
                yield from counted.add(tokens, np.array(ends, np.uint64), schema)
                columns = list(zip(*rows))
                owner, keys = _prefix_keys(tokens, np.array(counts), np.array(columns[3]), mix, a)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(rows) + 1)).astype(np.int32))
                at = pa.array(columns[0])
                kinds_of = [pa.int64()] * 3 + [pa.bool_()] + [pa.int32(), pa.int32(), pa.int32(), pa.int64()] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns[1:], kinds_of)), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.array([False] * len(rows))],
                    [doc, source, *(f.split()[0] for f in fields.split(", "))],
                )
        if schema is not None:
            yield from counted.rest(schema)

    class _Counts:
        """Occurrences and closings of word codes, added up before they are handed on."""

        def __init__(self):
            self.parts: list[tuple] = []
            self.size = 0

        def add(self, tokens, ends, schema) -> Iterator:
            import numpy as np

            distinct, number = np.unique(tokens, return_counts=True)
            closes = np.zeros(len(distinct), np.int64)
            e, k = np.unique(ends, return_counts=True)
            at = np.searchsorted(distinct, e)
            closes[at] = k
            self.parts.append((distinct, number.astype(np.int64), closes))
            self.size += len(distinct)
            if self.size > 4 * COUNTED:
                self._merge()
                if self.size > COUNTED:
                    yield from self.rest(schema)

        def _merge(self) -> None:
            import numpy as np

            codes, place = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            totals = [np.zeros(len(codes), np.int64) for _ in range(2)]
            for k in range(2):
                np.add.at(totals[k], place, np.concatenate([p[k + 1] for p in self.parts]))
            self.parts, self.size = [(codes, *totals)], len(codes)

        def rest(self, schema) -> Iterator:
            import pyarrow as pa

            if not self.parts:
                return
            self._merge()
            codes, total, closes = self.parts[0]
            n = len(codes)
            null = lambda kind: pa.nulls(n, kind)
            self.parts, self.size = [], 0
            middle = [null(k) for k in [pa.int32(), pa.int32(), pa.int32(), pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays(
                [null(schema.field(0).type), null(schema.field(1).type), pa.array(codes.astype("int64")), pa.array(total), pa.array(closes), null(pa.bool_()), *middle, null(pa.list_(pa.int64())), pa.array([True] * n)],
                [doc, source, *(f.split()[0] for f in fields.split(", "))],
            )

    return written(slim.mapInArrow(run, ", ".join(kinds) + ", " + fields))


def without_marker(text: str) -> str:
    """``text`` without a closing mark that says that it goes on elsewhere; ``text`` itself where it has none."""
    end = len(text.rstrip())
    found = _MARKER.search(text, max(0, end - 200), end)
    return text[: found.start()] if found else text


class _Codes(dict):
    """Word to 64-bit hash, remembered."""

    def __init__(self, digest):
        self.digest = digest

    def __missing__(self, word: str) -> int:
        code = self[word] = self.digest(word)
        return code


def _prefix_keys(tokens, counts, bare, mix, a):
    """(owner, key), by owner and level: BANDS keys for each signed prefix of each text, the longest last. ``counts`` are
    the words of each text in ``tokens``, ``bare`` those that count."""
    import numpy as np

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = bare - SHINGLE + 1
    begins = np.cumsum(counts) - counts
    texts = np.nonzero(number >= LEAST)[0]
    if not len(texts):
        return none
    levels = np.floor(np.log2(number[texts] / LEAST)).astype(np.int64) + 1
    with np.errstate(over="ignore"):
        shingle = np.zeros(len(tokens) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            shingle = (shingle ^ tokens[j : j + len(shingle)]) * mix[j]
            shingle ^= shingle >> np.uint64(31)
        # pieces of each text: its first LEAST shingles, then as many again, twice as many, ...
        owner = np.repeat(texts, levels)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = begins[owner] + np.where(level == 0, 0, LEAST << np.maximum(level - 1, 0))
        high = begins[owner] + (LEAST << level)
        edges = np.empty(2 * len(low), np.int64)
        edges[0::2], edges[1::2] = low, np.minimum(high, len(shingle) - 1)
        minima = []
        for m in a:
            h = shingle * m
            h ^= h >> np.uint64(32)
            piece = np.minimum.reduceat(h, edges)[0::2]
            # the last piece of the last text may reach the end, where reduceat has no right edge
            if high[-1] >= len(shingle):
                piece[-1] = h[low[-1] :].min()
            for step in range(1, int(levels.max())):
                at = np.nonzero(level == step)[0]
                piece[at] = np.minimum(piece[at], piece[at - 1])
            minima.append(piece)
        keys = np.empty((len(owner), BANDS), np.uint64)
        for b in range(BANDS):
            k = (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
            for r in range(ROWS):
                k = (k ^ minima[b * ROWS + r]) * mix[r]
                k ^= k >> np.uint64(29)
            keys[:, b] = k
    return np.repeat(owner, BANDS), keys.reshape(-1).astype(np.int64)


UNRELATED, SAME_END, ENDS_EARLY = range(3)


def relation(short: str, long: str) -> int:
    """How ``short`` stands to ``long``: ``ENDS_EARLY`` for a copy that stops before it (nearly all its shingles are in
    ``long``, the last ones in place, and ``long`` goes on there for more than a closing line), ``SAME_END`` for another
    copy, else ``UNRELATED``."""
    size, places = _places(long)
    a = words(without_marker(short))
    count = len(a) - SHINGLE + 1
    if count < LEAST:
        return UNRELATED
    early = False
    if size >= len(a) + EARLY and len(a) >= 2 * SHINGLE:
        for back in range(1, min(8, count) + 1):  # the last aligned shingle, a word cut in the middle aside
            found = places.get(tuple(a[count - back : count - back + SHINGLE]))
            if found:
                at = min(found, key=lambda i: abs(i - (count - back)))
                rest = size - (at + SHINGLE)
                end = len(words(_last_lines(long, 1)[-1]))
                mark, shape, _ = closing(short)
                complete = mark == STOP or shape not in (PROSE, SHORT_ITEM)
                added = end if end <= 15 and complete else 0
                early = at >= 0.6 * (count - back) and rest > max(EARLY, added)
                break
    if sum(tuple(a[i : i + SHINGLE]) in places for i in range(count)) < SIMILAR * count:
        return UNRELATED
    return ENDS_EARLY if early else SAME_END


@lru_cache(2)
def _places(text: str) -> tuple[int, dict[tuple, list[int]]]:
    """Number of words, and where each shingle is; kept for the pairs with the same longer text that follow."""
    b = words(text)
    places: dict[tuple, list[int]] = {}
    for i in range(len(b) - SHINGLE + 1):
        places.setdefault(tuple(b[i : i + SHINGLE]), []).append(i)
    return len(b), places


def _texts_of(table: DataFrame, documents: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """(text_hash, text) for the ``wanted`` (text_hash): one document of each, sifted before any shuffle."""
    of = table.where("not vocab").join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.min(doc).alias(doc))
    of = written(of.where(F.col(doc).isNotNull()))
    return sifted(documents.select(doc, text), doc, of).join(of, doc).select("text_hash", text)


def _members(table: DataFrame) -> DataFrame:
    """(key, text_hash, n, bare, left, open) of the bands in which a text meets a longer one: ``open`` where the band is of
    the text's longest signed prefix, so that it may be found cut there, ``left`` (all) where it may be the longer one.
    Copies are one text. Bands are reduced to their longest and shortest first, so that the
    many bands of one text are dropped by a count that combines before the shuffle."""
    rows = table.where("not vocab and size(keys) > 0").select(
        "text_hash", "n", "bare", F.size("keys").alias("of"), F.posexplode("keys").alias("i", "key")
    )
    rows = rows.select("key", "text_hash", "n", "bare", (F.col("i") >= F.col("of") - BANDS).alias("own"))
    met = (
        rows.groupBy("key")
        .agg(F.max("n").alias("most"), F.min(F.when(F.col("own"), F.col("bare"))).alias("least"))
        .where(F.col("most") >= F.col("least") + EARLY)
        .select("key")
    )
    return written(rows.join(met, "key", "left_semi").groupBy("key", "text_hash").agg(F.max("n").alias("n"), F.max("bare").alias("bare"), F.lit(True).alias("left"), F.max("own").alias("open")))


def early_copies(table: DataFrame, documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(text_hash) of the texts that a longer copy shows to be cut.

    First the longest text of each band is laid beside all others. Those it shows to be cut are done. Those that end
    where it ends or before it need not be met as longer ones: a text cut beside one of them is cut beside the first. So a
    family of near copies takes one round whatever its size. Texts still open then meet the longer ones that are left in
    their bands, longest first, in rounds of FURTHER times as many, to the last; nothing is capped.
    """
    members = _members(table)
    done = known = None
    most = 1
    while True:
        order = Window.partitionBy("key").orderBy(F.desc("n"), "text_hash")
        top = members.where("left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        top = top.select("key", F.col("text_hash").alias("long"), F.col("n").alias("long_n"))
        fits = F.col("open") & (F.col("long_n") >= F.col("bare") + EARLY)
        beside = members.join(top, "key").where("text_hash != long").withColumn("fits", fits)
        active = written(beside.groupBy("key").agg(F.max("fits").alias("active")).where("active").select("key"))
        if active.isEmpty():
            break
        laid = written((beside if most == 1 else beside.where("fits")).join(active, "key", "left_semi").select("key", "text_hash", "long"))
        pairs = laid.select("text_hash", "long").distinct()
        found = written(_verified(table, documents, pairs if known is None else pairs.join(known, ["text_hash", "long"], "left_anti"), doc, text))
        known = pairs if known is None else known.union(pairs)
        cut = found.where(F.col("relation") == ENDS_EARLY).select("text_hash").distinct()
        done = cut if done is None else done.union(cut)
        out = top.select("key", F.col("long").alias("text_hash"))
        if most == 1:  # kin of the longest
            out = out.union(laid.join(found, ["text_hash", "long"]).select("key", "text_hash"))
        out = out.distinct().withColumn("out", F.lit(True))
        here = members.join(active, "key", "left_semi").join(out, ["key", "text_hash"], "left").join(done.distinct().withColumn("over", F.lit(True)), "text_hash", "left")
        members = written(
            here.select("key", "text_hash", "n", "bare", (F.col("left") & F.col("out").isNull()).alias("left"), (F.col("open") & F.col("over").isNull()).alias("open")).where("left or open")
        )
        most *= FURTHER
    return done.distinct() if done is not None else table.select("text_hash").limit(0)


def _verified(table: DataFrame, documents: DataFrame, pairs: DataFrame, doc: str, text: str) -> DataFrame:
    """(text_hash, long, relation) of the ``pairs`` that are copies in some way."""
    wanted = pairs.select("text_hash").union(pairs.select("long")).distinct()
    texts = written(_texts_of(table, documents, wanted, doc, text))
    both = pairs.join(texts.withColumnRenamed(text, "short_text"), "text_hash").join(texts.select(F.col("text_hash").alias("long"), F.col(text).alias("long_text")), "long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of = [relation(s, t) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            hits = pa.array([i for i, r in enumerate(of) if r != UNRELATED], pa.int64())
            if len(hits):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(hits), batch.column(1).take(hits), pa.array([r for r in of if r != UNRELATED], pa.int32())], ["text_hash", "long", "relation"])

    ordered = both.sortWithinPartitions("long").select("text_hash", "long", "short_text", "long_text")
    return ordered.mapInArrow(run, "text_hash long, long long, relation int")


#: Shares of a word's occurrences that close a sentence or line: the edges of the classes of terminality.
RATES = (0.0, 0.01, 0.03, 0.1, 0.3)
#: Occurrences beside its own that a word must have to be placed by its rate.
SEEN = 2


def _terminality(total, closes, kind):
    """The class of a closing word: its form, with 0 for words hardly seen elsewhere, else the class of its rate."""
    rest = F.coalesce(total, F.lit(0)) - 1
    rate = F.coalesce(closes, F.lit(0)) / F.greatest(rest, F.lit(1))
    of = F.lit(len(RATES) + 1)
    for k, edge in reversed(list(enumerate(RATES))):
        of = F.when(rate <= edge, k + 1).otherwise(of)
    return kind * 8 + F.when(rest < SEEN, 0).otherwise(of)


class Terminality:
    """Ratios of closes: for a mark, a shape and a class of closing word, how often texts end so against how often the
    same texts, cut at random, would. Counts run over all texts. A class of few observations leans on the wider one
    (word class on shape, shape on what it is taken for before)."""

    def __init__(self, cells: dict[tuple[int, int, int], tuple[int, int]]):
        ends = sum(n for n, _ in cells.values())
        cuts = sum(s for _, s in cells.values())
        scale = ends / cuts if cuts else 1.0
        wide: dict[tuple[int, int], list[float]] = {}
        for (mark, shape, _), (n, s) in cells.items():
            w = wide.setdefault((mark, shape), [0.0, 0.0])
            w[0] += n
            w[1] += s * scale
        self.wide = {k: (n + WEIGHT * self.prior(*k)) / (s + WEIGHT) for k, (n, s) in wide.items()}
        self.ratio = {k: (n + WEIGHT * self.wide[k[:2]]) / (s * scale + WEIGHT) for k, (n, s) in cells.items()}
        # the share of cuts: the ratio of the closes that are most like random places, over half of these places
        low = mass = 0.0
        for k in sorted(self.ratio, key=self.ratio.get):
            low, mass = low + cells[k][0], mass + cells[k][1] * scale
            if mass * 2 >= ends:
                break
        self.share = low / mass if mass else 0.0
        self.most = min(max(RATIO, 1.5 * self.share), 0.8)

    @staticmethod
    def prior(mark: int, shape: int) -> float:
        return 4.0 if mark == STOP else PRIOR_SHAPE.get(shape, PRIOR.get(mark, 1.0))

    def cut(self) -> list[tuple[int, int, int]]:
        """The classes of closes that tell a cut."""
        return [k for k, r in self.ratio.items() if r <= self.most]


def _cut_closes(table: DataFrame) -> DataFrame:
    """(mark, shape, kind, code) of the closes that tell a cut. Only counts of classes reach the driver, at most a few
    thousand."""
    vocabulary = table.where("vocab").groupBy(F.col("text_hash").alias("code")).agg(F.sum("n").alias("total"), F.sum("bare").alias("closes"))
    texts = table.where("not vocab")
    ends = texts.where("mark is not null").select("mark", "shape", "kind", "code", F.lit(1).alias("end"), F.lit(0).alias("cut"))
    cuts = texts.where("at_mark is not null").select("at_mark", "at_shape", "at_kind", "at_code", F.lit(0), F.lit(1))
    closes = ends.union(cuts).groupBy("mark", "shape", "kind", "code").agg(F.sum("end").alias("end"), F.sum("cut").alias("cut"))
    placed = written(closes.join(vocabulary, "code", "left").withColumn("class", _terminality(F.col("total"), F.col("closes"), F.col("kind"))).drop("total", "closes"))
    cells = placed.groupBy("mark", "shape", "class").agg(F.sum("end").alias("end"), F.sum("cut").alias("cut")).collect()
    told = Terminality({(r["mark"], r["shape"], r["class"]): (r["end"], r["cut"]) for r in cells}).cut()
    spark = table.sparkSession
    return placed.join(spark.createDataFrame(told, "mark int, shape int, class int"), ["mark", "shape", "class"], "left_semi").select("mark", "shape", "kind", "code")


def judge(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, source, cut, why): each non-blank text with whether it is cut and by what sign (copy, word, mark)."""
    table = features(documents, doc, text, source)
    early = early_copies(table, documents, doc, text).withColumn("early", F.lit(True))
    open_ = _cut_closes(table).withColumn("open", F.lit(True))
    joined = table.where("not vocab").select(doc, source, "text_hash", "marked", "mark", "shape", "kind", "code").join(early, "text_hash", "left").join(open_, ["mark", "shape", "kind", "code"], "left")
    why = F.when(F.col("early"), "copy").when(F.col("open"), "word").when(F.col("marked"), "mark")
    return joined.select(doc, source, why.isNotNull().alias("cut"), why.alias("why"))


def find_cut(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc) of the texts that stop before their end."""
    return judge(documents, doc, text, source).where("cut").select(doc).distinct()


def cut_by_source(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, texts, cut, share): how often each source cuts its texts; texts without a source are one group."""
    return (
        judge(documents, doc, text, source)
        .groupBy(source)
        .agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut"))
        .withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
    )
