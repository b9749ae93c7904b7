"""DuckDB SQL with the results of the registry's queries, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.rules import DOUBLE_SUFFIXES, LAST_SUFFIXES, NOUN_SUFFIXES, STOP_WORDS

AND_QUERY = "grace reason virtue"
OR_QUERY = "grace OR reason"
DUP_QUERY = "virtue virtue OR grace"
PHRASE_QUERY = '"third book" grace'
MULTI_PHRASE_QUERY = '"third book" "second day"'
LIVE_QUERY = "the virtue of natural grace"
BATCH_QUERIES = [(1, "grace", 5), (2, "virtue OR grace", 7), (3, "the of", 5), (4, '"second day" reason', 6), (5, "reason zzzz", 3), (6, "virtue", 0)]
SNIPPET_TERMS = ["grace", "reason"]
TEST_DOMAINS = ("college-tranimstead.example", "org.example", "skerasalund-archive.test")
ROBOTS_AGENT = "otherbot"
SEED_HOST = "college-tranimstead.example"
TOP_N = 10

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _raw(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(translate(coalesce({text}, ''), 'İ', ' ')), '[^a-z0-9\\-]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))"


def _left(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _shape(s: str) -> str:
    """``c`` and ``v`` for each letter of ``s``; y is a vowel after a consonant."""
    vowel = "ch IN ('a', 'e', 'i', 'o', 'u') OR (ch = 'y' AND right(acc, 1) = 'c')"
    return f"list_reduce(string_split({s}, ''), lambda acc, ch: acc || CASE WHEN {vowel} THEN 'v' ELSE 'c' END, '')"


def _m1(s: str) -> str:
    return f"contains({_shape(s)}, 'cv')"


def _m2(s: str) -> str:
    return f"{_shape(s)} LIKE '%cv%cv%'"


def _vowel(s: str) -> str:
    return f"contains({_shape(s)}, 'v')"


def _cvc(s: str) -> str:
    return f"(ends_with({_shape(s)}, 'cvc') AND right({s}, 1) NOT IN ('w', 'x', 'y'))"


def _table_case(table) -> str:
    whens = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_m1(_left(len(s)))} THEN {_left(len(s))} || '{to}' ELSE w END" for s, to in table)
    return f"CASE {whens} ELSE w END"


def _last_case() -> str:
    out = ""
    for s in LAST_SUFFIXES:
        base = _left(len(s))
        more = f" AND (ends_with({base}, 's') OR ends_with({base}, 't'))" if s == "ion" else ""
        out += f" WHEN ends_with(w, '{s}') AND {_m2(base)}{more} THEN {base}"
    return f"CASE{out} ELSE w END"


_STEPS = (
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_left(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') AND length(w) > 1 THEN {_left(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m1(_left(3))} THEN {_left(1)} ELSE w END"
    f" WHEN ends_with(w, 'ed') THEN CASE WHEN {_vowel(_left(2))} THEN {_left(2)} || '|' ELSE w END"
    f" WHEN ends_with(w, 'ing') THEN CASE WHEN {_vowel(_left(3))} THEN {_left(3)} || '|' ELSE w END ELSE w END",
    f"CASE WHEN NOT ends_with(w, '|') THEN w WHEN regexp_matches({_left(1)}, '(at|bl|iz)$') THEN {_left(1)} || 'e'"
    f" WHEN length(w) > 2 AND w[-2] = w[-3] AND w[-2] NOT IN ('l', 's', 'z') AND ends_with({_shape(_left(1))}, 'c') THEN {_left(2)}"
    f" WHEN {_m1(_left(1))} AND NOT {_m2(_left(1))} AND {_cvc(_left(1))} THEN {_left(1)} || 'e' ELSE {_left(1)} END",
    f"CASE WHEN ends_with(w, 'y') AND length(w) > 1 AND {_vowel(_left(1))} THEN {_left(1)} || 'i' ELSE w END",
    _table_case(DOUBLE_SUFFIXES),
    _table_case(NOUN_SUFFIXES),
    _last_case(),
    f"CASE WHEN ends_with(w, 'e') AND ({_m2(_left(1))} OR ({_m1(_left(1))} AND NOT {_cvc(_left(1))})) THEN {_left(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND {_m2(_left(1))} THEN {_left(1)} ELSE w END",
)


def _stems(source: str, prefix: str = "") -> str:
    """CTEs that end in ``{prefix}stems`` (token, term) for the distinct tokens of ``source``."""
    out = [f"{prefix}v0 AS (SELECT DISTINCT token, token AS w FROM {source})"]
    for i, step in enumerate(_STEPS):
        out.append(f"{prefix}v{i + 1} AS (SELECT token, {step} AS w FROM {prefix}v{i})")
    out.append(f"{prefix}stems AS (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE w END AS term FROM {prefix}v{len(_STEPS)})")
    return ",\n".join(out)


_DOCS = """docs AS (SELECT doc_id, CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN left(text, strpos(text, chr(10)) - 1) ELSE coalesce(text, '') END AS title,
 concat_ws('/', coalesce(source, ''), doc_id) AS path, ['Pdf', 'Markdown', 'Html'][doc_id % 3 + 1] AS content_type, coalesce(text, '') AS content FROM documents)"""
_RAW = f"raw AS (SELECT doc_id, {_raw('content')} AS toks FROM docs)"
_TOKENS = "tokens AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks)))::INT AS pos FROM raw)"
_POSTINGS = """terms AS (SELECT doc_id, term, pos FROM tokens JOIN stems USING (token)),
post AS (SELECT term, doc_id, count(*)::INT AS tf, list(pos ORDER BY pos) AS positions FROM terms GROUP BY term, doc_id),
lens AS (SELECT doc_id, len(toks)::INT AS doc_len FROM raw),
stats AS (SELECT count(*) AS n, coalesce(avg(doc_len), 0) AS avgdl FROM lens)"""
INDEX = f"WITH {_DOCS}, {_RAW}, {_TOKENS}, {_stems('tokens')}, {_POSTINGS}"


def _stemmed(*words: str) -> list[str]:
    from ..functions.twin import stem

    return [stem(w) for w in words]


def _search(required: list[str], optional: list[str] = (), phrases: list[list[str]] = (), name: str = "res") -> str:
    """CTEs ending in ``name`` (doc_id, score)."""
    terms = [*required, *optional, *(t for p in phrases for t in p)]
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))
    conditions = [f"sum((term = '{t}')::INT) = 1" for t in sorted(set(required))]
    for p in phrases:
        first = f"coalesce(max(CASE WHEN term = '{p[0]}' THEN positions END), [])"
        rest = " AND ".join(f"list_contains(coalesce(max(CASE WHEN term = '{t}' THEN positions END), []), x + {i})" for i, t in enumerate(p[1:], 1)) or "true"
        conditions.append(f"len(list_filter({first}, lambda x: {rest})) > 0")
    having = f" HAVING {' AND '.join(conditions)}" if conditions else ""
    return f""", {name}_q(term, c) AS (VALUES {values}),
{name}_df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
{name}_m AS (SELECT doc_id FROM post JOIN {name}_q USING (term) GROUP BY doc_id{having}),
{name} AS (SELECT doc_id, round(sum(c * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score
 FROM post JOIN {name}_q USING (term) JOIN {name}_df USING (term) JOIN {name}_m USING (doc_id) JOIN lens USING (doc_id), stats GROUP BY doc_id)"""


_AND = _search(_stemmed("grace", "reason", "virtue"))
_ANY = _search([], _stemmed("grace", "reason", "virtue"))
_OR = _search(_stemmed("grace"), _stemmed("reason"))
_TOP = "(SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM res)"


def _hits(t: str) -> str:
    """Starts of ``t`` in the small-letter text, from the lengths of the pieces between them."""
    return (
        f"list_transform(range(1, len(string_split(low, '{t}'))), lambda i:"
        f" list_sum(list_transform(string_split(low, '{t}')[1:i], lambda x: length(x))) + (i - 1) * {len(t)})"
    )


_IN = " + ".join(f"len(list_filter(h{i}, lambda x: x >= p AND x < p + 280)) + CASE WHEN len(list_filter(h{i}, lambda x: x >= p AND x < p + 280)) > 0 THEN 1000 ELSE 0 END" for i in range(len(SNIPPET_TERMS)))


_SNIP = f"""WITH {_DOCS},
lo AS (SELECT doc_id, content, lower(content) AS low FROM docs),
h AS (SELECT doc_id, content, {', '.join(f'{_hits(t)} AS h{i}' for i, t in enumerate(SNIPPET_TERMS))} FROM lo),
s AS (SELECT doc_id, content, length(content) AS n, list_transform(range(0, greatest(length(content), 1), 40), lambda p: {_IN}) AS scores FROM h),
w AS (SELECT doc_id, content, n, CASE WHEN list_max(scores) > 0 THEN ((list_position(scores, list_max(scores)) - 1) * 40)::INT END AS start FROM s),
e AS (SELECT *, least(n, start + 280) AS stop, strpos(substr(content, start + 1, 30), ' ') AS ahead FROM w),
f AS (SELECT *, CASE WHEN start > 0 AND ahead > 0 THEN start + ahead ELSE start END AS first_at, substr(content, (stop - least(stop, 30) + 1)::BIGINT, least(stop, 30)::BIGINT) AS tail FROM e),
b AS (SELECT *, strpos(reverse(tail), ' ') AS back FROM f),
l AS (SELECT *, CASE WHEN stop < n AND back > 0 AND stop - back > first_at THEN stop - back ELSE stop END AS last_at FROM b)"""
_MARK = "regexp_replace({0}, '((?:grace|reason)[\\p{{L}}\\p{{N}}_\\p{{M}}]*)', '<mark>\\1</mark>', 'gi')"

_SHOWN = (
    "CASE WHEN start IS NULL THEN CASE WHEN n > 280 THEN left(content, 280) || '...' ELSE content END"
    + f" ELSE CASE WHEN first_at > 0 THEN '...' ELSE '' END || {_MARK.format('substr(content, (first_at + 1)::BIGINT, (last_at - first_at)::BIGINT)')} || CASE WHEN last_at < n THEN '...' ELSE '' END END"
)


def _result(named) -> str:
    """A whole result as one JSON text; ``named`` spells the names of its fields."""
    item = f"{{{named('title')}: title, {named('url')}: path, {named('snippet')}: '', {named('score')}: score, {named('sourceType')}: list_position(['Pdf', 'Markdown', 'Html'], content_type) - 1, {named('isScholarly')}: false, {named('domain')}: NULL}}"
    items = f"(SELECT list({item} ORDER BY rank) FROM {_TOP} JOIN docs USING (doc_id) WHERE rank <= {TOP_N})"
    return f"to_json({{{named('query')}: '{OR_QUERY}', {named('totalMatches')}: (SELECT count(*) FROM res), {named('elapsedMilliseconds')}: 0.0::DOUBLE, {named('items')}: {items}}})::VARCHAR"


_ABS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::[0-9]*)?([^?#\s]*)(\?[^#\s]*)?(?:#.*)?$"


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_ABS}', {group})"


def _key(url: str) -> str:
    bare = f"regexp_replace({_part(url, 2)}, '(?i)^www\\.', '')"
    return (
        f"CASE WHEN trim({url}) = '' THEN {url} WHEN regexp_matches({url}, '{_ABS}') THEN lower('https://' || {bare} || rtrim({_part(url, 3)}, '/') || {_part(url, 4)})"
        f" ELSE lower(rtrim({url}, '/')) END"
    )


def _host(url: str) -> str:
    return f"nullif(lower({_part(url, 2)}), '')"


def _scholarly(url: str) -> str:
    tests = " OR ".join(f"{_host(url)} = '{d}' OR ends_with({_host(url)}, '.{d}')" for d in TEST_DOMAINS)
    return f"coalesce({tests}, false)"


_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_T = "coalesce(title, '')"
# Text as the page shows it: titles and paragraphs of the written HTML, entities decoded once more where the text holds them.
_DEC = lambda c: (
    f"replace(replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)
_TEXT = f"regexp_replace(regexp_replace({_DEC(' ' + chr(39) + ' ' + chr(39) + ' || ' + _ESC(_T) + ' || ' + chr(39) + '   ' + chr(39) + ' || replace(' + _ESC('coalesce(text_content, ' + chr(39) * 2 + ')') + ', chr(10), ' + chr(39) + ' ' + chr(39) + ' || chr(10) || ' + chr(39) + ' ' + chr(39) + ') || ' + chr(39) + '  top   mail   next  ' + chr(39) + ' || repeat(' + chr(39) + ' more  ' + chr(39) + ', len(coalesce(out_links, [])))')}, '[\\s\\x{{85}}\\p{{Z}}]{{2,}}', ' ', 'g'), '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g')"

_LIVE = f"""hits AS (SELECT page_id AS pos, url, title, text_content, success FROM crawled QUALIFY row_number() OVER (PARTITION BY {_key('url')} ORDER BY page_id) = 1),
good AS (SELECT lower(url) AS k, min(page_id) AS pid FROM crawled WHERE success AND trim(coalesce(text_content, '')) <> '' GROUP BY 1),
found AS (SELECT h.pos, h.url, h.title, c.title AS page_title, c.text_content FROM hits h JOIN good g ON lower(h.url) = g.k JOIN crawled c ON c.page_id = g.pid),
raw AS (SELECT pos AS doc_id, {_raw('text_content')} AS toks FROM found),
{_TOKENS}, {_stems('tokens')}, {_POSTINGS},
shown AS (SELECT *, CASE WHEN trim(coalesce(page_title, '')) <> '' THEN page_title ELSE title END AS name FROM found),
ttok AS (SELECT pos, unnest({_raw('name')}) AS token FROM shown), {_stems('ttok', 't')},
ttitle AS (SELECT pos, list(DISTINCT term) AS terms FROM ttok JOIN tstems USING (token) GROUP BY pos)"""
_Q3 = _stemmed("virtue", "natural", "grace")
_BOOST = f"round(1.0 + 0.3 * len(list_filter([{', '.join(repr(t) for t in _Q3)}], lambda t: list_contains(coalesce(terms, []), t))) / 3.0, 6)"
_LIVE_SCORED = f"""WITH {_LIVE}, q(term) AS (VALUES {', '.join(f"('{t}')" for t in _Q3)}),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))) AS s
 FROM post JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY doc_id),
res AS (SELECT f.pos, f.url, f.name AS title, round(coalesce(s, 0) * (1.0 + 0.3 * len(list_filter([{', '.join(repr(t) for t in _Q3)}], lambda t: list_contains(coalesce(terms, []), t))) / 3.0)
 * CASE WHEN {_scholarly('f.url')} THEN 1.5 ELSE 1 END, 6) AS score, {_scholarly('f.url')} AS is_scholarly, replace({_host('f.url')}, 'www.', '') AS domain
 FROM shown f LEFT JOIN sc ON sc.doc_id = f.pos LEFT JOIN ttitle t ON t.pos = f.pos)"""

_ROBOTS = f"""rl AS (SELECT host, unnest(string_split(coalesce(content, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(content, ''), chr(10))))) AS pos FROM robots_txt),
rc AS (SELECT host, pos, trim(replace(replace(regexp_replace(line, '#.*$', ''), chr(13), ' '), chr(9), ' ')) AS c FROM rl),
rn AS (SELECT host, pos, lower(trim(split_part(c, ':', 1))) AS name, trim(substr(c, strpos(c, ':') + 1)) AS value FROM rc WHERE contains(c, ':')),
ra AS (SELECT *, last_value(CASE WHEN name = 'user-agent' THEN lower(value) END IGNORE NULLS) OVER (PARTITION BY host ORDER BY pos ROWS UNBOUNDED PRECEDING) AS agent FROM rn),
ro AS (SELECT *, max((contains('{ROBOTS_AGENT}', agent))::INT) OVER (PARTITION BY host) AS own FROM ra),
rm AS (SELECT * FROM ro WHERE value <> '' AND CASE WHEN own = 1 THEN contains('{ROBOTS_AGENT}', agent) ELSE agent = '*' END),
rules AS (SELECT r.host, coalesce(list(value ORDER BY value) FILTER (WHERE name = 'allow'), []) AS allow, coalesce(list(value ORDER BY value) FILTER (WHERE name = 'disallow'), []) AS disallow
 FROM robots_txt r LEFT JOIN rm USING (host) GROUP BY r.host)"""


def _path_match(path: str, rule: str) -> str:
    escaped = f"replace(regexp_replace(lower({rule}), '([.^$+?()\\[\\]{{}}|\\\\])', '\\\\\\1', 'g'), '*', '.*')"
    return (
        f"CASE WHEN {rule} = '' THEN false WHEN ends_with({rule}, '$') THEN lower({path}) = left(lower({rule}), length({rule}) - 1)"
        f" WHEN contains({rule}, '*') THEN regexp_matches(lower({path}), {escaped}, 's') ELSE starts_with(lower({path}), lower({rule})) END"
    )


def _allowed(path: str, allow: str, deny: str) -> str:
    longest = lambda rules: f"coalesce(list_max(list_transform(list_filter({rules}, lambda r: {_path_match(path, 'r')}), lambda r: length(r))), -1)"
    return f"{longest(allow)} >= {longest(deny)}"


_PATH = f"CASE WHEN {_part('url', 3)} = '' THEN '/' ELSE {_part('url', 3)} END"
_CACHE_KEY = "concat_ws(':', 'search', coalesce(mode, 'live'), coalesce(top_n, 10), lower(trim(coalesce(query, ''))))"
_TTL = """WITH RECURSIVE log AS (SELECT DISTINCT ts, user_id, query, mode, top_n FROM query_log WHERE ts IS NOT NULL AND trim(query) <> ''),
k AS (SELECT {key} AS key, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM log),
r AS (SELECT key, ts, i, false AS hit, ts + INTERVAL {ttl} SECOND AS until FROM k WHERE i = 1
 UNION ALL SELECT k.key, k.ts, k.i, k.ts < r.until, CASE WHEN k.ts < r.until THEN r.until ELSE k.ts + INTERVAL {ttl} SECOND END FROM r JOIN k ON k.key = r.key AND k.i = r.i + 1)"""

_BASE_NEXT = f"lower({_part('url', 1)} || '://' || {_part('url', 2)}) || regexp_extract(CASE WHEN {_part('url', 3)} = '' THEN '/' ELSE {_part('url', 3)} END, '^(.*/)', 1) || 'next?p=2'"

_EXTRACT = f"""WITH l AS (SELECT page_id, list_concat([{_BASE_NEXT}], list_transform(coalesce(out_links, []), lambda u: regexp_replace(u, '#.*$', ''))) AS ls FROM crawled),
 g AS (SELECT page_id, len(list_filter(ls, lambda u: regexp_matches(u, '^https?://')))::INT AS links FROM l)
 SELECT page_id, trim({_DEC(_ESC(_T))}) AS page_title, length({_TEXT})::INT AS text_length, links FROM crawled JOIN g USING (page_id)"""

SQL: dict[str, str] = {
    "tokenize": INDEX + " SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS tokens FROM docs d LEFT JOIN terms USING (doc_id) GROUP BY d.doc_id",
    "stopword_filter": f"WITH {_DOCS}, {_RAW} SELECT doc_id, array_to_string(toks, ' ') AS tokens FROM raw",
    "stem_vocab": INDEX + " SELECT token, term FROM stems",
    "build_postings": INDEX + " SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM post",
    "doc_lengths": f"WITH {_DOCS}, {_RAW} SELECT doc_id, len(toks)::INT AS doc_len FROM raw",
    "corpus_stats": INDEX + " SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "term_df": INDEX + " SELECT term, count(*) AS df FROM post GROUP BY term",
    "term_idf": INDEX + " SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats",
    "doc_terms": INDEX + " SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms FROM post GROUP BY doc_id",
    "all_doc_ids": "SELECT doc_id FROM documents",
    "postings_lookup": "SELECT DISTINCT term, doc_id, coalesce(tf, len(positions))::INT AS tf FROM postings WHERE term IN ('grace', 'natur')",
    "posting_point": "SELECT DISTINCT term, doc_id, coalesce(tf, len(positions))::INT AS tf FROM postings WHERE term = 'natur' AND doc_id = (SELECT min(doc_id) FROM postings WHERE term = 'natur')",
    "delete_docs": INDEX + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post JOIN docs USING (doc_id) WHERE content_type <> 'Pdf' GROUP BY term",
    "upsert_docs": f"""WITH {_DOCS}, ch AS (SELECT doc_id - 1 AS doc_id, content FROM docs WHERE doc_id % 3 = 1),
 after AS (SELECT doc_id, content FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ch) UNION ALL SELECT * FROM ch)
 SELECT doc_id, len({_raw('content')})::INT AS doc_len FROM after""",
    "stream_index": INDEX + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "store_round_trip": INDEX + " SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "search_any": INDEX + _ANY + " SELECT doc_id FROM res",
    "search_and": INDEX + _AND + " SELECT doc_id, score FROM res",
    "and_intersect": INDEX + _AND + " SELECT doc_id FROM res",
    "docs_missing_term": INDEX + f" SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = '{_stemmed('grace')[0]}')",
    "search_or": INDEX + _OR + " SELECT doc_id, score FROM res",
    "bm25_scores": INDEX + _ANY + " SELECT doc_id, score FROM res",
    "search_dup_terms": INDEX + _search(_stemmed("virtue", "virtue"), _stemmed("grace")) + " SELECT doc_id, score FROM res",
    "search_phrase": INDEX + _search(_stemmed("grace"), [], [_stemmed("third", "book")]) + " SELECT doc_id, score FROM res",
    "search_multi_phrase": INDEX + _search([], [], [_stemmed("third", "book"), _stemmed("second", "day")]) + " SELECT doc_id, score FROM res",
    "search_content_type": INDEX + _AND + " SELECT doc_id, score FROM res JOIN docs USING (doc_id) WHERE content_type = 'Html'",
    "search_total": INDEX + _OR + " SELECT count(*) AS total_matches FROM res",
    "search_topn": INDEX + _OR + f" SELECT rank, doc_id, score FROM {_TOP} WHERE rank <= {TOP_N}",
    "search_page2": INDEX + _OR + f" SELECT rank, doc_id, score FROM {_TOP} WHERE rank > {TOP_N} AND rank <= {2 * TOP_N}",
    "batch_search": INDEX
    + _search(_stemmed("grace"), name="q1")
    + _search(_stemmed("virtue"), _stemmed("grace"), name="q2")
    + _search(_stemmed("reason"), [], [_stemmed("second", "day")], name="q4")
    + " SELECT qid, rank, doc_id, score FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM"
    " (SELECT 1 AS qid, * FROM q1 UNION ALL SELECT 2, * FROM q2 UNION ALL SELECT 4, * FROM q4)) WHERE rank <= CASE qid WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 6 END",
    "empty_query": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false",
    "result_json": INDEX + _OR + f" SELECT {_result(lambda n: n)} AS json",
    "sse_frames": INDEX + _OR + f" SELECT 'event: scored' || chr(10) || 'data: ' || {_result(lambda n: n[0].upper() + n[1:])} || chr(10) || chr(10) AS frame",
    "search_items": INDEX
    + _OR
    + f", best AS (SELECT * FROM {_TOP} WHERE rank <= {TOP_N}), "
    + _SNIP.removeprefix(f"WITH {_DOCS},").replace("FROM docs", "FROM docs WHERE doc_id IN (SELECT doc_id FROM best)", 1).replace("lo AS", "lo AS", 1)
    + f", shown AS (SELECT doc_id, {_SHOWN} AS snippet FROM l)"
    + " SELECT rank, title, path AS url, snippet, score, content_type AS source_type, false AS is_scholarly, NULL::VARCHAR AS domain FROM best JOIN docs USING (doc_id) JOIN shown USING (doc_id)",
    "snippet_prefix": f"WITH {_DOCS} SELECT doc_id, CASE WHEN length(content) > 280 THEN left(content, 280) || '...' ELSE content END AS snippet FROM docs",
    "snippet_window": _SNIP + " SELECT doc_id, start FROM w",
    "snippet_highlight": f"WITH {_DOCS} SELECT doc_id, {_MARK.format('content')} AS marked FROM docs",
    "snippet_text": _SNIP + f" SELECT doc_id, {_SHOWN} AS snippet FROM l",
    "url_normalize": f"SELECT page_id, {_key('url')} AS key FROM crawled",
    "seed_normalize": "SELECT page_id, rtrim(CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'https://' || u END, '/') AS seed FROM (SELECT page_id, regexp_replace(url, '^https://', '') AS u FROM crawled)",
    "url_domain": f"SELECT page_id, replace({_host('url')}, 'www.', '') AS domain FROM crawled",
    "is_scholarly": f"SELECT page_id, {_scholarly('url')} AS is_scholarly FROM crawled",
    "unwrap_redirect": "SELECT page_id, url_decode(url) AS target FROM crawled",
    "augment_query": "SELECT DISTINCT query, CASE WHEN regexp_matches(lower(query), 'scholar|academic|journal|paper|site:') THEN query ELSE query || ' scholarly theology philosophy' END AS augmented FROM query_log",
    "cache_key": f"SELECT {_CACHE_KEY} AS cache_key, count(*) AS n FROM query_log GROUP BY 1",
    "dedupe_urls": f"SELECT page_id AS pos, url, title FROM crawled QUALIFY row_number() OVER (PARTITION BY {_key('url')} ORDER BY page_id) = 1",
    "dedupe_exact": "SELECT page_id AS pos, url FROM crawled QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY page_id) = 1",
    "html_title": f"SELECT page_id, trim({_DEC(_ESC(_T))}) AS title FROM crawled",
    "html_text": f"SELECT page_id, {_TEXT} AS text FROM crawled",
    "extract_links": f"""WITH l AS (SELECT page_id, url, list_concat([{_BASE_NEXT}], list_transform(coalesce(out_links, []), lambda u: regexp_replace(u, '#.*$', ''))) AS ls FROM crawled),
 e AS (SELECT page_id, unnest(ls) AS u FROM l), g AS (SELECT page_id, list(u) AS us FROM e WHERE regexp_matches(u, '^https?://') GROUP BY page_id)
 SELECT page_id, unnest(range(len(us)))::INT AS ordinal, unnest(us) AS link FROM g""",
    "html_extract": _EXTRACT,
    "html_extract_any": _EXTRACT,
    "robots_parse": f"WITH {_ROBOTS} SELECT host, array_to_string(allow, ' ') AS allow, array_to_string(disallow, ' ') AS disallow FROM rules",
    "robots_gate": f"WITH {_ROBOTS}, p AS (SELECT page_id, {_host('url')} AS host, regexp_replace({_host('url')}, '^www\\.', '') AS bare, {_PATH} AS path FROM crawled)"
    f" SELECT page_id, {_allowed('path', 'coalesce(allow, [])', 'coalesce(disallow, [])')} AS robots_allowed FROM p LEFT JOIN rules ON rules.host = p.bare",
    "robots_allowed": f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM crawled) SELECT path, {_allowed('path', chr(91) + repr('/library/law') + ', ' + repr('/a*poverty') + ', ' + repr('/read$') + chr(93), chr(91) + ', '.join(map(repr, ('/library', '/a', '/READ', '/*.pdf$', '*grace'))) + chr(93))} AS allowed FROM p",
    "fetch_gate": """WITH s AS (SELECT url, regexp_extract(coalesce(error, ''), '^HTTP (\\d{3})', 1) AS st, regexp_extract(coalesce(error, ''), '^Non-HTML content type: (.*)$', 1) AS media FROM crawled),
 e AS (SELECT url, CASE WHEN st <> '' AND st::INT NOT BETWEEN 200 AND 299 THEN 'HTTP ' || st::INT || ' Error' WHEN media <> '' AND NOT regexp_matches(lower(media), 'html|text') THEN 'Non-HTML content type: ' || media END AS error FROM s)
 SELECT url, error IS NULL AS success, error FROM e""",
    "content_type_by_ext": "SELECT page_id, ['Markdown', 'Html', 'Pdf', 'Markdown', 'Markdown', 'Html'][page_id % 6 + 1] AS content_type FROM crawled",
    "index_url": "SELECT url AS doc_id, url, 'Html' AS content_type FROM crawled WHERE success AND trim(coalesce(text_content, '')) <> '' ORDER BY page_id LIMIT 1",
    "crawl_report": "SELECT count(*) FILTER (coalesce(success, false)) AS succeeded, count(*) FILTER (NOT coalesce(success, false)) AS failed, coalesce(sum(length(text_content)), 0)::BIGINT AS content_length FROM crawled",
    "crawl_depths": f"""WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM links WHERE {_host('src')} = {_host('dst')}),
 r(url, depth) AS (SELECT min(src), 0 FROM links WHERE {_host('src')} = '{SEED_HOST}' UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = url WHERE depth < 3)
 SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""",
    "live_search": _LIVE_SCORED + " SELECT pos, url, score, is_scholarly, domain FROM res",
    "live_items": _LIVE_SCORED
    + f" SELECT row_number() OVER (ORDER BY score DESC, pos)::INT AS rank, title, url, score, 'Html' AS source_type, is_scholarly, domain FROM res QUALIFY rank <= {TOP_N}",
    "live_fallback": f"""WITH h AS (SELECT page_id AS pos, url, title, left(coalesce(text_content, ''), 160) AS snippet FROM crawled QUALIFY row_number() OVER (PARTITION BY {_key('url')} ORDER BY page_id) = 1)
 SELECT row_number() OVER (ORDER BY pos)::INT AS rank, title, url, snippet, 0.0::DOUBLE AS score, 'Html' AS source_type, false AS is_scholarly, NULL::VARCHAR AS domain FROM h QUALIFY rank <= {TOP_N}""",
    "title_boost": f"""WITH ttok AS (SELECT page_id AS pos, unnest({_raw('title')}) AS token FROM crawled), {_stems('ttok', 't')},
 ttitle AS (SELECT pos, list(DISTINCT term) AS terms FROM ttok JOIN tstems USING (token) GROUP BY pos)
 SELECT page_id, {_BOOST} AS boost FROM crawled LEFT JOIN ttitle ON pos = page_id""",
    "debounce_flushes": """WITH e AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 2 SECOND THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
 g AS (SELECT ts, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT max(ts) + INTERVAL 2 SECOND AS flush_at, count(*) AS mutations FROM g GROUP BY g""",
    "cache_hits": _TTL.format(key="concat_ws(':', 'search', coalesce(mode, 'live'), coalesce(top_n, 10), lower(trim(query)))", ttl=300) + " SELECT key, ts, hit FROM r",
    "response_cache": _TTL.format(key="concat_ws(':', 'search', coalesce(mode, 'live'), coalesce(top_n, 10), lower(trim(query)))", ttl=120) + " SELECT hit, count(*) AS n FROM r GROUP BY hit",
    "recent_history": """WITH l AS (SELECT user_id, lower(query) AS f, max(ts) AS ts FROM query_log WHERE trim(coalesce(query, '')) <> '' GROUP BY 1, 2),
 q AS (SELECT l.user_id, l.f, l.ts, max(x.query) AS query FROM l JOIN query_log x ON x.user_id IS NOT DISTINCT FROM l.user_id AND lower(x.query) = l.f AND x.ts IS NOT DISTINCT FROM l.ts GROUP BY 1, 2, 3)
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, f)::INT AS rank, query, ts FROM q QUALIFY rank <= 20""",
    "health": "SELECT 'healthy' AS status",
}
SQL["live_stream_phases"] = (
    _LIVE_SCORED
    + f""", d AS (SELECT row_number() OVER (ORDER BY pos)::INT AS rank, url, title FROM hits QUALIFY rank <= {TOP_N}), x AS (SELECT *, {"round(score / CASE WHEN is_scholarly THEN 1.5 ELSE 1 END, 6)"} AS plain FROM res)
 SELECT 'discovery' AS phase, rank, url, title FROM d UNION ALL SELECT 'scored', row_number() OVER (ORDER BY plain DESC, pos)::INT AS rank, url, title FROM x QUALIFY rank <= {TOP_N}"""
)
