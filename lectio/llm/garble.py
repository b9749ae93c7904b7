"""Text decoded with the wrong character encoding: detection and repair (problem 3).

1. Adjacent character pairs with a non-ASCII member are counted over the whole corpus, and each pair gets a smoothed
   pointwise mutual information (:class:`PairModel`).
2. The pairs around each run of non-ASCII characters score by their improbability (lacking mutual information); the
   maximum-scoring segments of these scores are the suspect runs (:meth:`PairModel.segments`). Pairs of ASCII characters
   count as probable, so a segment may bridge them; characters outside all segments are left alone.
3. Only inside the segments are inverse mappings tested: the bytes under a wrong decoding, read again as UTF-8 (once to
   three times), or as the Western single-byte encoding. A segment is bounded by pairs, so its first and last character
   may be right, or be part of bytes that go on: they are tried with, without, and out to the next ASCII character. A mapping is taken where it makes the pairs clearly more probable.

A value is affected if a run has such an inverse, or holds a replacement character (U+FFFD) or a C1 control, for which
no original can be had. Foreign words, accented capitals, symbols and other scripts that are meant have no inverse that
is more probable and stay. Null and empty values are never affected; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that texts are wrongly read with, where the text was UTF-8 (tested first: the byte pattern is strict).
MULTI = ("cp1252", "cp437", "mac_roman", "cp1251", "cp1250", "cp850", "iso8859_2", "koi8_r", "gb18030")
#: The same, where the text was in the Western single-byte encoding.
SINGLE = ("mac_roman", "cp437", "cp1251", "cp850", "cp1250")
_WEST = "cp1252"
#: Smoothing of a character's count, as a share of all characters: a rarer character counts as this frequent.
RARE = 1e-4
#: A single-byte mapping must raise the mean pair score by this, alone, or by LEAST beside a strong or two sure ones
#: in the value.
ALONE, STRONG, LEAST = 2.4, 3.5, 0.4
#: A UTF-8 mapping may not lower the mean pair score by more than this.
DROP = 3.6
#: Each further round of strict UTF-8 decoding is worth this: garbled text that was garbled again is undone wholly.
DEEPER = 3.0
#: Taken off where the restored text has a character that the corpus never has.
UNSEEN = 3.0
#: Letters of a run up to which every mixture of letter case is tried (3 to the power of it at most); a garbled word has
#: two to four of them, and longer runs were put in one case as a whole.
CASED = 4
#: A pair below this mutual information adds to the improbability of a segment.
PROBABLE = 2.5

#: Where segments are looked for: characters beyond ASCII, and an ASCII character between such ones where the first is
#: of no Latin script (the second byte of a double-byte encoding may be one).
_RUN = re.compile(r"[^\x00-\x7f]+(?:(?<=[\u0370-\uffff])[\x40-\x7e][^\x00-\x7f]+)*")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def _alphabet() -> frozenset[str]:
    chars = {chr(i) for i in range(256)}
    for name in (*MULTI[:-1], _WEST):
        chars |= set(bytes(range(256)).decode(name, "ignore"))
    return frozenset(chars)


#: Characters counted as themselves: ASCII and all of the single-byte encodings, below 700. Every other character is
#: counted as its block of 4,096 (at most 272), so the pair table has a fixed bound below a million rows.
ALPHABET = _alphabet()


def fold(ch: str) -> str:
    return ch if ch in ALPHABET else chr(ord(ch) >> 12 << 12 | 0xFFF)


def count_pairs(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(a, b, n): counts of adjacent folded characters with a non-ASCII member over ``columns``; ``b`` = -1 holds the
    counts of single characters. Ends of a value count as line ends. Counting is vectorised per batch and added per
    worker before the shuffle, which moves a few thousand rows a task."""
    columns = list(columns)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        total: dict[int, int] = {}
        known: dict[int, int] = {}

        def folded(code: int) -> int:
            if code not in known:
                known[code] = code if 0xD800 <= code < 0xE000 else ord(fold(chr(code)))
            return known[code]

        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            for name in columns:
                texts = [t for t in batch.column(name).to_pylist() if t]
                if not texts:
                    continue
                codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
                high = codes > 127
                ascii_counts = np.bincount(codes[~high], minlength=128)
                for c in np.nonzero(ascii_counts)[0]:
                    total[int(c) << 32 | 0xFFFFFFFF] = total.get(int(c) << 32 | 0xFFFFFFFF, 0) + int(ascii_counts[c])
                for c, n in zip(*np.unique(codes[high], return_counts=True)):
                    k = folded(int(c)) << 32 | 0xFFFFFFFF
                    total[k] = total.get(k, 0) + int(n)
                at = np.nonzero(high[:-1] | high[1:])[0]
                pairs = codes[at].astype(np.uint64) << np.uint64(32) | codes[at + 1].astype(np.uint64)
                for p, n in zip(*np.unique(pairs, return_counts=True)):
                    p = int(p)
                    k = folded(p >> 32) << 32 | folded(p & 0xFFFFFFFF)
                    total[k] = total.get(k, 0) + int(n)
        if total:
            import pyarrow as pa

            keys = np.fromiter(total, np.uint64, len(total))
            b = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).astype(np.int64)
            b[b == 0xFFFFFFFF] = -1
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"a": (keys >> np.uint64(32)).astype(np.int64), "b": b, "n": np.fromiter(total.values(), np.int64, len(total))}),
                preserve_index=False,
            )

    parts = df.select(*columns).mapInArrow(run, "a long, b long, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


class PairModel:
    """Smoothed pointwise mutual information of adjacent characters, and the repair that uses it."""

    def __init__(self, rows: Iterable[tuple[int, int, int]]):
        self.single: dict[str, int] = {}
        self.pair: dict[tuple[str, str], int] = {}
        for a, b, n in rows:
            if b < 0:
                self.single[chr(a)] = n
            else:
                self.pair[chr(a), chr(b)] = n
        self.n = max(1, sum(self.single.values()))
        self.known: dict[tuple[str, str, str], tuple] = {}

    @classmethod
    def fit(cls, df: DataFrame, columns: Iterable[str]) -> PairModel:
        """Counts over the whole table; what reaches the driver is the pair table of bounded size (see ALPHABET)."""
        return cls((r.a, r.b, r.n) for r in count_pairs(df, columns).toLocalIterator())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def score(self, a: str, b: str) -> float:
        a, b = fold(a), fold(b)
        rare = RARE * self.n
        return math.log((self.pair.get((a, b), 0) + 0.5) * self.n / ((self.single.get(a, 0) + rare) * (self.single.get(b, 0) + rare)))

    def mean(self, s: str) -> float:
        """Mean score of the pairs of ``s`` that have a non-ASCII member."""
        scores = [self.score(a, b) for a, b in zip(s, s[1:]) if a > "\x7f" or b > "\x7f"]
        return sum(scores) / len(scores) if scores else 0.0

    def decide(self, left: str, run: str, right: str) -> tuple[tuple[int, int, str, str, float], ...]:
        """(start, end, original, mapping, gain) within ``run`` for its suspect segments that have an inverse, given the
        characters beside it. Decisions depend on the run and its neighbours only and are remembered."""
        key = (left, run, right)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[key] = tuple(self._inverses(left, run, right))
        return got

    def _inverses(self, left: str, run: str, right: str) -> Iterator[tuple[int, int, str, str, float]]:
        s = left + run + right
        done = 0
        for a, b in self.segments(s):
            low, high = max(a, 1), min(b, len(s) - 1)
            wide, end = low, high  # a segment may end within the bytes of one character: out to the next ASCII
            while wide > 1 and s[wide - 1] > "\x7f":
                wide -= 1
            while end < len(s) - 1 and s[end] > "\x7f":
                end += 1
            best = None
            for start, stop in dict.fromkeys(((wide, end), (low, high), (low + 1, high), (low, high - 1), (low + 1, high - 1))):
                if start < done or stop <= start or s[start:stop].isascii():
                    continue
                original, mapping, gain = self._decide(s[start - 1], s[start:stop], s[stop])
                # a longer part that is restored explains more of the segment
                if original is not None and (best is None or (stop - start, gain) > (best[1] - best[0], best[4])):
                    best = (start - 1, stop - 1, original, mapping, gain)
            if best is not None:
                done = best[1] + 1
                yield best

    def segments(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the disjoint maximum-scoring segments of ``s`` in characters, where each pair scores by how far
        its mutual information falls short of PROBABLE, and a pair of ASCII characters by -1."""
        scores = [PROBABLE - self.score(a, b) if a > "\x7f" or b > "\x7f" else -1.0 for a, b in zip(s, s[1:])]
        # all maximal segments in one pass: each candidate keeps the sums before and after it
        kept: list[tuple[int, int, float, float]] = []
        total = 0.0
        for i, x in enumerate(scores):
            before, total = total, total + x
            if x <= 0:
                continue
            start, left = i, before
            while kept:
                j = next((k for k in range(len(kept) - 1, -1, -1) if kept[k][2] < left), None)
                if j is None or kept[j][3] >= total:
                    break
                start, left = kept[j][0], kept[j][2]
                del kept[j:]
            kept.append((start, i + 1, left, total))
        return [(a, b + 1) for a, b, _, _ in kept]

    def _decide(self, left: str, run: str, right: str) -> tuple[str | None, str, float]:
        base = self.mean(left + run + right)
        best: tuple[float, str, str] | None = None
        for variant in _cases(run):
            for name in MULTI:
                text = variant
                for again in range(3):
                    text = _utf8(text, name if not again else _WEST)
                    if text is None or text == run:
                        break
                    score = self.mean(left + text + right) + DEEPER * again - UNSEEN * any(fold(c) not in self.single for c in text)
                    if best is None or score > best[0]:
                        best = (score, text, name)
            if best is not None and variant == run:
                break
        if best is not None and best[0] > base - (DROP if best[2] != "gb18030" else 0.0):
            return best[1], f"utf-8 read as {best[2]}", STRONG + max(0.0, best[0] - base)
        best = None
        for name in SINGLE:
            text = _west(run, name)
            if text and text != run:
                score = self.mean(left + text + right)
                if best is None or score > best[0]:
                    best = (score, text, name)
        if best is not None and best[0] - base > LEAST:
            return best[1], f"{_WEST} read as {best[2]}", best[0] - base
        return None, "", 0.0

    def repair(self, text: str | None) -> tuple[str | None, bool]:
        """(text with its garbled runs restored, whether it held any)."""
        if not text or text.isascii():
            return text, False
        lost = _LOST.search(text) is not None
        found: list[tuple[int, int, str, str, float]] = []
        decide, n = self.decide, len(text)
        for m in _RUN.finditer(text):
            a, b = m.span()
            for low, high, *rest in decide(text[a - 1] if a else "\n", m.group(), text[b] if b < n else "\n"):
                found.append((a + low, a + high, *rest))
        if found:
            sure = Counter(f[3] for f in found if f[4] >= ALONE)
            strong = {f[3] for f in found if f[4] >= STRONG or sure[f[3]] > 1}
            found = [f for f in found if f[4] >= ALONE or f[3] in strong]
        if not found:
            return text, lost
        out, at = [], 0
        for a, b, original, _, _ in found:
            out += [text[at:a], original]
            at = b
        return "".join(out) + text[at:], True


def _cases(run: str) -> Iterator[str]:
    """The run, then its spellings with other letter case: a garbled line may have been put in capitals or small
    letters afterwards. All spellings are tried for up to CASED letters, beyond that all-small and all-capital."""
    yield run
    seen = {run}
    for variant in (run.lower(), run.upper()):
        if variant not in seen and len(variant) == len(run):
            seen.add(variant)
            yield variant
    if sum(c.lower() != c.upper() for c in run) <= CASED:
        for combo in itertools.product(*({c, c.lower(), c.upper()} for c in run)):
            variant = "".join(combo)
            if variant not in seen and len(variant) == len(run):
                seen.add(variant)
                yield variant


def _utf8(text: str, wrong: str) -> str | None:
    """``text`` as it was before UTF-8 bytes were read as ``wrong``, or null."""
    try:
        data = text.encode(wrong)
    except UnicodeEncodeError:
        if wrong != _WEST:
            return None
        data = bytearray()  # bytes that cp1252 leaves undefined pass through as controls
        for ch in text:
            try:
                data += ch.encode(wrong)
            except UnicodeEncodeError:
                if ord(ch) > 255:
                    return None
                data.append(ord(ch))
    except UnicodeError:
        return None
    try:
        out = bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if out != text and not out.isascii() else None


def _west(text: str, wrong: str) -> str | None:
    try:
        return text.encode(wrong).decode(_WEST)
    except UnicodeError:
        return None


def repair_columns(df: DataFrame, columns: Iterable[str], model: PairModel | None = None) -> DataFrame:
    """``df`` with, for each of ``columns``, the restored text in place and a flag ``<column>_garbled``; columns that
    already have such a name are replaced."""
    import pyspark.sql.types as T

    columns = list(columns)
    model = model or PairModel.fit(df, columns)
    shared = df.sparkSession.sparkContext.broadcast(model)
    flags = [f"{c}_garbled" for c in columns]
    df = df.drop(*flags)
    schema = T.StructType([*df.schema.fields, *(T.StructField(f, T.BooleanType()) for f in flags)])
    names = df.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        repair = shared.value.repair
        for batch in batches:
            cols = {n: batch.column(n) for n in names}
            for c, f in zip(columns, flags):
                done = [repair(t) for t in cols[c].to_pylist()]
                cols[c] = pa.array([t for t, _ in done], pa.string())
                cols[f] = pa.array([g for _, g in done], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return df.mapInArrow(run, schema)


def find_garbled(df: DataFrame, key: str = "page_id", columns: Iterable[str] = ("title", "text_content")) -> DataFrame:
    """(key, field, restored): each garbled value with the text restored as far as it can be had. Two passes over the
    text (pair counts, then decisions); no shuffle of the texts."""
    columns = list(columns)
    slim = df.select(key, *columns)
    shared = slim.sparkSession.sparkContext.broadcast(PairModel.fit(slim, columns))
    kind = slim.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        repair = shared.value.repair
        for batch in batches:
            keys = batch.column(0)
            for c in columns:
                hits = [(i, r) for i, t in enumerate(batch.column(c).to_pylist()) if t for r, bad in (repair(t),) if bad]
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array([i for i, _ in hits])), pa.array([c] * len(hits)), pa.array([r for _, r in hits])],
                        [key, "field", "restored"],
                    )

    return slim.mapInArrow(run, f"`{key}` {kind}, field string, restored string")
