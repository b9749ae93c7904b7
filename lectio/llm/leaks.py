"""Evaluation texts leaking into training text (problem 9).

Spaced seeds: fixed masks over word positions, each hashing some positions of a window and ignoring the others, so that a
changed word spoils only the masks that look at it. Hashes of the items and of the documents are joined; around the hits
the item is aligned with the document, and a pair is a leak if matching stretches of the item cover enough of its words.

* A stretch is a maximum-scoring run of matching words in running order: a match adds one, a changed, added or missing
  word takes COST, and a gap of more than GAP of them ends it. It counts from a score of LEAST, so instructions and
  quotations of up to eight words never do.
* A pair is a leak if its one or two longest stretches, in the same order in both texts, hold SHARE of the item's words.

Null, empty and blank texts on either side leak nothing, and items of fewer than LEAST words are no cases (a quotation of
so few is none); ids may be of any type; repeated documents are reported each; repeated pairs once; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Masks of weight six: the positions of a window that are looked at. Together they give six hits on any nine equal
#: words in a row, and three or more on most stretches of a dozen with one changed.
MASKS = ((0, 1, 2, 4, 5, 7), (0, 2, 3, 5, 6, 8), (0, 1, 2, 3, 5, 6))
SHARE, LEAST, GAP, STRETCHES = 0.25, 9, 4, 2
#: What a changed, added or missing word takes from the score of a stretch, where a matching word adds one.
COST = 1.5
#: Hits that a pair needs to be aligned: nine equal words in a row give seven, a dozen with one changed at least three.
HITS = 3
SIEVE_BITS = 22
#: Bytes of all item texts up to which they are sent to every task (a seed of 16 bytes a mask and word at most); beyond it
#: seeds are joined by a shuffle.
SENT_BYTES = 8_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Small-letter words; marks, spacing and line ends do not count."""
    return _WORD.findall(text.lower()) if text else []


def align(item: list, doc: list, hits: list[int]) -> tuple[int, int]:
    """(matching words in the best one or two stretches, stretches) of ``item`` in ``doc`` around hit positions."""
    low, high = max(0, min(hits) - len(item) - GAP), min(len(doc), max(hits) + len(item) + GAP)
    blocks = [b for b in SequenceMatcher(None, item, doc[low:high], autojunk=False).get_matching_blocks() if b.size]
    stretches: list[tuple[int, int]] = []  # (score, matched words) of the maximum-scoring segments
    score = matched = 0
    peak = (0, 0)
    end_a = end_b = 0
    for b in blocks:
        gap = max(b.a - end_a, b.b - end_b)
        if score and (gap > GAP or gap * COST >= score):
            stretches.append(peak)
            score = matched = 0
            peak = (0, 0)
        elif score:
            score -= gap * COST
        score += b.size
        matched += b.size
        peak = max(peak, (score, matched))
        end_a, end_b = b.a + b.size, b.b + b.size
    stretches.append(peak)
    best = sorted((m for s, m in stretches if s >= LEAST), reverse=True)[:STRETCHES]
    return sum(best), len(best)


class Items:
    """The evaluation items as word numbers and seeds."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        import numpy as np

        self.vocabulary: dict[str, int] = {}
        self.tokens: dict[int, list[int]] = {}
        for item, text in rows:
            ws = words(text)
            if len(ws) >= LEAST:
                self.tokens[item] = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
        hashes, owners = [], []
        for item, ts in self.tokens.items():
            for h in seed_hashes(np.array(ts, np.int64)):
                h = h[1]
                hashes.append(h)
                owners.append(np.full(len(h), item, np.int64))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        self.hashes, self.owners = h[keep], o[keep]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)  # a look-up that rejects nearly all windows before the search
        self.sieve[(self.hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def candidates(self, starts, tokens) -> dict[tuple[int, int], list[int]]:
        """Hit positions by (row, item) for a batch of documents laid end to end."""
        import numpy as np

        found: dict[tuple[int, int], list[int]] = {}
        row_of = np.searchsorted(starts, np.arange(len(tokens)), "right") - 1
        for at, h in seed_hashes(tokens, row_of):
            may = self.sieve[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
            at, h = at[may], h[may]
            left = np.searchsorted(self.hashes, h, "left")
            right = np.searchsorted(self.hashes, h, "right")
            hit = np.nonzero(right > left)[0]
            rows = row_of[at[hit]]
            for row, pos, a, b in zip(rows.tolist(), (at[hit] - starts[rows]).tolist(), left[hit].tolist(), right[hit].tolist()):
                for item in self.owners[a:b].tolist():
                    found.setdefault((row, item), []).append(pos)
        return {pair: hits for pair, hits in found.items() if len(hits) >= HITS}


def seed_hashes(tokens, row_of=None) -> list[tuple]:
    """(positions, hashes) for each mask; windows with an unknown word at a looked-at position, or over two documents,
    are left out."""
    import numpy as np

    out = []
    n = len(tokens)
    t = tokens.astype(np.uint64) + np.uint64(1)
    known = tokens >= 0
    with np.errstate(over="ignore"):
        for k, mask in enumerate(MASKS):
            span = mask[-1] + 1
            m = n - span + 1
            if m <= 0:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
                continue
            ok = known[:m].copy()
            for off in mask[1:]:
                ok &= known[off : off + m]
            if row_of is not None:
                ok &= row_of[:m] == row_of[span - 1 :]
            at = np.nonzero(ok)[0]
            h = np.full(len(at), 0x9E3779B97F4A7C15 + k, np.uint64)
            for off in mask:
                h = (h ^ t[at + off]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            out.append((at, h))
    return out


def enough(item_words: int, matched: int) -> bool:
    return matched >= SHARE * item_words


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, item_words, matched): each document with each item that leaked into it."""
    spark = documents.sparkSession
    evals = items.select(item, text).where(F.col(text).isNotNull())
    size = evals.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    if size > SENT_BYTES:
        return _find_by_join(documents, evals, doc, item, text)
    ids, texts = zip(*((r[0], r[1]) for r in evals.collect())) if size else ((), ())
    shared = spark.sparkContext.broadcast((Items(list(enumerate(texts))), ids))
    slim = documents.select(doc, text)
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((slim, doc), (evals, item))}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, ids = shared.value
        kind = {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[item])
        number = known.vocabulary.get
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = [[number(w, -1) for w in words(t)] for t in part.column(1).to_pylist()]
                starts = np.zeros(len(lists) + 1, np.int64)
                np.cumsum([len(x) for x in lists], out=starts[1:])
                flat = np.fromiter((w for x in lists for w in x), np.int64, int(starts[-1]))
                rows, found, sizes, matched = [], [], [], []
                for (row, e), hits in known.candidates(starts[:-1], flat).items():
                    tokens = known.tokens[e]
                    n, _ = align(tokens, lists[row], hits)
                    if enough(len(tokens), n):
                        rows.append(row)
                        found.append(ids[e])
                        sizes.append(len(tokens))
                        matched.append(n)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array(found, kind), pa.array(sizes, pa.int32()), pa.array(matched, pa.int32())],
                        [doc, item, "item_words", "matched"],
                    )

    return slim.mapInArrow(run, f"`{doc}` {kinds[doc]}, `{item}` {kinds[item]}, item_words int, matched int")


def _find_by_join(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str) -> DataFrame:
    """The same for a set of items too large to send: seeds of both sides are joined by hash, hit positions are gathered
    by pair (at most the words of a document), and the two texts join for the alignment."""

    def seeds(key: str, kind: str):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import xxhash

            code = lambda w: xxhash.xxh64_intdigest(w) >> 2
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ws = words(t)
                    if len(ws) < LEAST:
                        continue
                    for at, h in seed_hashes(np.array([code(w) for w in ws], np.int64)):
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(h.astype(np.int64)), pa.array(at.astype(np.int32))], [key, "hash", "pos"])

        return run, f"`{key}` {kind}, hash long, pos int"

    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((documents, doc), (items, item))}
    ours = documents.select(doc, text).mapInArrow(*seeds(doc, kinds[doc]))
    theirs = items.select(item, text).mapInArrow(*seeds(item, kinds[item])).select(item, "hash").distinct()
    hits = ours.join(theirs, "hash").groupBy(doc, item).agg(F.collect_list("pos").alias("hits")).where(F.size("hits") >= HITS)
    pairs = hits.join(documents.select(doc, F.col(text).alias("doc_text")), doc).join(items.select(item, F.col(text).alias("item_text")), item)

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, sizes, matched = [], [], []
            for i, (hits, d, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hits", "doc_text", "item_text")))):
                ws = words(e)
                n, _ = align(ws, words(d), hits)
                if enough(len(ws), n):
                    rows.append(i)
                    sizes.append(len(ws))
                    matched.append(n)
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc).take(take), batch.column(item).take(take), pa.array(sizes, pa.int32()), pa.array(matched, pa.int32())],
                    [doc, item, "item_words", "matched"],
                )

    return pairs.mapInArrow(check, f"`{doc}` {kinds[doc]}, `{item}` {kinds[item]}, item_words int, matched int").distinct()
