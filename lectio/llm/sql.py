"""DuckDB SQL with the results of the pN_ queries, where SQL can state them."""

from __future__ import annotations

#: Exact copies once; a null tf falls back to the number of positions; blank terms name no term.
_ROWS = """
rows AS (SELECT DISTINCT term, doc_id, tf, positions FROM postings WHERE doc_id IS NOT NULL AND trim(term) <> ''),
per AS (SELECT term, doc_id, CAST(sum(greatest(coalesce(tf, len(positions), 0), 0)) AS BIGINT) AS tf FROM rows GROUP BY term, doc_id),
stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM per GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM postings),
marked AS (SELECT term, occurrences, records,
                  CASE WHEN records < 4 THEN 'rare' WHEN records > n * 0.25 THEN 'common' END AS mark FROM stats, n),
scored AS (SELECT doc_id, term, tf, round(tf * (log2(n::DOUBLE / records) + log2(1.0 - exp(-occurrences / n::DOUBLE))), 6) AS score
           FROM per JOIN stats USING (term), n)
"""

SQL: dict[str, str] = {
    "p2_found": f"WITH {_ROWS} SELECT doc_id, term FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) = 1",
    "p2_scores": f"WITH {_ROWS} SELECT doc_id, term, tf, score FROM scored",
    "p6_found": f"WITH {_ROWS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_frequencies": f"WITH {_ROWS} SELECT term, occurrences, records, mark FROM marked",
}
