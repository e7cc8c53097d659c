"""DuckDB SQL for the registered retrieval queries, composed of shared CTEs."""

from __future__ import annotations

from corvane.plans.queries import SIZES, SWEEP

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DOCS = "docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, source || '/' || doc_id || '.md' AS source_path FROM documents)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def terms(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda t: lower(t))"


def structured(strategy: str) -> str:
    if strategy == "fixed":
        return "text"
    if strategy == "paragraph":
        return "replace(text, chr(10), chr(10) || chr(10))"
    return r"regexp_replace(text, '\n(\w)', chr(10) || chr(10) || '# \1 part' || chr(10) || chr(10) || '\1', 'g')"


def _windows(rows: str, first: str, past: str, size: int, overlap: int) -> str:
    """Stripped windows of a span per row of ``rows``: adds wi, body, a, b."""
    step = size - overlap
    n = f"CASE WHEN {past} - {first} <= {size} THEN 1 ELSE ceil(({past} - {first} - {size}) / {step}.0)::INT + 1 END"
    raw = f"substr(text, (w0 + 1)::BIGINT, (least({past}, w0 + {size}) - w0)::BIGINT)"
    return f"""(SELECT *, {strip('raw')} AS body, (w0 + length(raw) - length({lstrip('raw')}))::INT AS a,
        (w0 + length(raw) - length({lstrip('raw')}) + length({strip('raw')}))::INT AS b
      FROM (SELECT *, {raw} AS raw FROM (SELECT r.*, i AS wi, {first} + i * {step} AS w0 FROM {rows} r, unnest(range(0, {n})) AS t(i)))
      WHERE {strip('raw')} <> '')"""


def texts(strategy: str) -> str:
    return f"{DOCS}, texts AS (SELECT source_path AS path, regexp_extract(source_path, '([^/]*)\\.md$', 1) AS stem, text FROM (SELECT source_path, {structured(strategy)} AS text FROM docs) WHERE {strip('text')} <> '')"


LINES = f"""
lines AS (
  SELECT path, stem, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a
  FROM (SELECT path, stem, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM texts)),
headed AS (
  SELECT *, CASE WHEN regexp_matches({strip('line')}, '^#+ .') AND {strip("regexp_extract(" + strip('line') + ", '^#+ (.*)$', 1)")} <> '' THEN length(regexp_extract({strip('line')}, '^(#+) ', 1)) END AS level,
         {strip("regexp_extract(" + strip('line') + ", '^#+ (.*)$', 1)")} AS head
  FROM lines)"""

SECTIONS = f"""
marks AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY a) AS k, a, level, head, a + length(line) + 1 AS past FROM headed WHERE level IS NOT NULL),
ranges AS (
  SELECT t.path, t.text, stem AS title, NULL::INT AS level, 0 AS a, coalesce((SELECT min(a) FROM marks m WHERE m.path = t.path), length(t.text)) AS b, 0 AS k FROM texts t
  UNION ALL
  SELECT m.path, t.text, m.head, m.level, m.past, coalesce(n.a, length(t.text)), m.k FROM marks m JOIN texts t USING (path) LEFT JOIN marks n ON n.path = m.path AND n.k = m.k + 1),
sections AS (SELECT path, title, level, a AS first, b AS past, k FROM ranges WHERE {strip('substr(text, a::BIGINT + 1, greatest(b - a, 0)::BIGINT)')} <> ''),
last_section AS (SELECT path, arg_max(title, k) AS title, arg_max(level, k) AS level FROM sections GROUP BY path)"""


def fixed_chunks(size: int, overlap: int, name: str = "chunks", headings: bool = True) -> str:
    """CTE of fixed chunks: path, idx, body, a, b, title, level, kind."""
    if not headings:
        return f"{name} AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY wi) - 1 AS idx, body, a, b, stem AS title, NULL::INT AS level, 'fixed' AS kind, stem FROM {_windows('texts', '0', 'length(text)', size, overlap)})"
    return f"""{name}_w AS (SELECT * FROM {_windows('texts', '0', 'length(text)', size, overlap)}),
{name} AS (
  SELECT w.path, row_number() OVER (PARTITION BY w.path ORDER BY wi) - 1 AS idx, body, w.a, w.b, coalesce(s.title, l.title, w.stem) AS title,
         CASE WHEN s.path IS NOT NULL THEN s.level ELSE l.level END AS level, 'fixed' AS kind, w.stem
  FROM {name}_w w LEFT JOIN sections s ON s.path = w.path AND s.first <= w.a AND w.a < s.past LEFT JOIN last_section l ON l.path = w.path)"""


def grouped_chunks(strategy: str, size: int, overlap: int) -> str:
    """CTEs of paragraph or markdown chunks, by a recursive walk over group starts."""
    heads = "level IS NOT NULL" if strategy == "markdown" else "false"
    change = "x.K = o.K" if strategy == "markdown" else "true"
    return f"""
flagged AS (SELECT *, {heads} AS is_head, {strip('line')} = '' AS blank, sum(({heads})::INT) OVER (PARTITION BY path ORDER BY n) AS sec FROM headed),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY path ORDER BY n) AS island FROM flagged WHERE NOT is_head AND NOT blank),
paragraphs AS (
  SELECT path, any_value(stem) AS stem, min(a)::INT AS first, max(a + length(line))::INT AS past, any_value(sec) AS sec,
         {strip(f"string_agg(regexp_replace(line, '{WS}+$', ''), chr(10) ORDER BY n)")} AS body
  FROM runs GROUP BY path, island),
under AS (
  SELECT p.*, coalesce(h.head, p.stem) AS title, h.level, t.text FROM paragraphs p JOIN texts t USING (path)
  LEFT JOIN (SELECT path, sec, head, level FROM flagged WHERE is_head) h ON h.path = p.path AND h.sec = p.sec),
small AS (SELECT path, stem, first, first AS a, past AS b, 0 AS wi, body, title, level FROM under WHERE length(body) <= {size}),
large AS (SELECT path, stem, first, a, b, wi, body, title, level FROM {_windows(f"(SELECT path, stem, first, past, title, level, text FROM under WHERE length(body) > {size})", 'r.first'.replace('r.', ''), 'past', size, overlap)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first, wi) - 1 AS j, length(body) AS len FROM (SELECT * FROM small UNION ALL SELECT * FROM large)),
summed AS (
  SELECT *, sum(len) OVER w - len AS P, sum(changed) OVER w AS K, count(*) OVER (PARTITION BY path) AS m
  FROM (SELECT *, (coalesce(lag(title) OVER (PARTITION BY path ORDER BY j) <> title, false))::INT AS changed FROM numbered) WINDOW w AS (PARTITION BY path ORDER BY j)),
stops AS (
  SELECT o.path, o.j AS s, o.m, max(x.j) + 1 AS stop FROM summed o JOIN summed x ON x.path = o.path AND x.j >= o.j AND (x.j = o.j OR (x.P + x.len - o.P + 2 * (x.j - o.j) <= {size} AND {change})) GROUP BY ALL),
nexts AS (
  SELECT t.path, t.s, t.stop, t.m, coalesce(max(i.j), t.s + 1) AS nxt
  FROM stops t JOIN summed e ON e.path = t.path AND e.j = t.stop - 1
  LEFT JOIN summed i ON i.path = t.path AND i.j > t.s AND i.j < t.stop AND e.P + e.len - i.P >= {overlap} GROUP BY t.path, t.s, t.stop, t.m),
walk AS (
  SELECT path, s, stop, m, nxt FROM nexts WHERE s = 0
  UNION ALL SELECT n.path, n.s, n.stop, n.m, n.nxt FROM walk w JOIN nexts n ON n.path = w.path AND n.s = w.nxt WHERE w.stop < w.m),
groups AS (
  SELECT w.path, w.s, string_agg(b.body, chr(10) || chr(10) ORDER BY b.j) AS body, min(b.a) AS a, arg_max(b.b, b.j) AS b, arg_max(b.title, b.j) AS title, arg_max(coalesce(b.level, -1), b.j) AS level, any_value(b.stem) AS stem
  FROM walk w JOIN numbered b ON b.path = w.path AND b.j >= w.s AND b.j < w.stop GROUP BY w.path, w.s),
{fixed_chunks(size, overlap, 'bare')},
chunks AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS idx, body, a, b, title, nullif(level, -1) AS level, '{strategy}' AS kind, stem FROM groups
  UNION ALL SELECT path, idx, body, a, b, title, level, kind, stem FROM bare WHERE path NOT IN (SELECT path FROM numbered))"""


def chunk_ctes(strategy: str, size: int, overlap: int, structure: str | None = None) -> str:
    """WITH list up to ``chunks`` for the texts structured for a strategy, its own if none is named."""
    if strategy == "fixed":
        return f"WITH RECURSIVE {texts(structure or strategy)}, {LINES}, {SECTIONS}, {fixed_chunks(size, overlap)}"
    return f"WITH RECURSIVE {texts(structure or strategy)}, {LINES}, {SECTIONS}, {grouped_chunks(strategy, size, overlap)}"


def chunk_sql(strategy: str) -> str:
    return f"""{chunk_ctes(strategy, *SIZES[strategy])}
SELECT path || '::chunk-' || idx AS chunk_id, idx::INT AS chunk_index, a::INT AS start_char, b::INT AS end_char, title, level::INT AS heading_level, kind AS chunk_strategy, sha256(body) AS checksum FROM chunks"""


def bm25(corpus: str, queries: str, prefix: str = "", per_query: bool = False) -> str:
    """CTEs ending in ``{prefix}scored (query_id, position, score)`` from ``corpus (position, text)`` and ``queries (query_id, text)``."""
    p = prefix
    return f"""
{p}ct AS (SELECT position, {terms('text')} AS ts FROM {corpus}),
{p}stats AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM {p}ct),
{p}tf AS (SELECT position, length, term, count(*) AS tf FROM (SELECT position, len(ts) AS length, unnest(ts) AS term FROM {p}ct) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('text')}) AS term FROM {queries}) GROUP BY ALL),
{p}scored AS (
  SELECT query_id, position, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))) AS score
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}df USING (term), {p}stats GROUP BY query_id, position)"""


def ranked(scored: str, k: int, tie: str = "position") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {tie}) AS rank FROM {scored} WHERE score > 0) WHERE rank <= {k})"


CORPUS = f"{DOCS}, corpus AS (SELECT doc_id AS position, text, lang, source FROM docs), queries AS (SELECT item_id AS query_id, text FROM benchmark)"
BM25_DOCS = f"WITH {CORPUS}, {bm25('corpus', 'queries')}"
SHOW = "SELECT query_id, rank::INT AS rank, position AS doc_id, round(score, 6) AS score FROM"


def vectors(rows: str, key: str, name: str) -> str:
    """CTE of hash vectors as (key, slot, v)."""
    return f"""
{name}_raw AS (
  SELECT {key}, ((byte + 17 * i) % 128)::INT AS slot, sum(tf * CASE WHEN byte % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM (SELECT {key}, tf, i, ('0x' || substr(sha256(tok), (2 * i + 1)::BIGINT, 2))::INT AS byte
        FROM (SELECT {key}, tok, count(*) AS tf FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda w: w <> '')) AS tok FROM {rows}) GROUP BY ALL), unnest(range(0, 16)) AS t(i))
  GROUP BY ALL),
{name} AS (SELECT {key}, slot, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_raw WHERE v <> 0)"""


DENSE_DOCS = f"""{CORPUS}, {vectors('corpus', 'position', 'dv')}, {vectors('queries', 'query_id', 'qv')},
dense AS (SELECT query_id, position, sum(q.v * d.v) AS score FROM qv q JOIN dv d USING (slot) GROUP BY ALL)"""

BLENDED = f"""WITH {DENSE_DOCS},
sets AS (SELECT position, list_distinct({terms('text')}) AS ts, list_distinct({terms("source || ' ' || lang")}) AS ms FROM corpus),
asked AS (SELECT query_id, list_distinct({terms('text')}) AS qs FROM queries),
parts AS (
  SELECT a.query_id, s.position, coalesce(d.score, 0) AS dense, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ts)) / len(qs)::DOUBLE END AS lex, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ms)) / len(qs)::DOUBLE END AS meta
  FROM asked a CROSS JOIN sets s LEFT JOIN dense d ON d.query_id = a.query_id AND d.position = s.position),
mixed AS (SELECT query_id, position, greatest(dense, lex, 0.65::DOUBLE * dense + 0.25::DOUBLE * lex + 0.1::DOUBLE * meta) AS score FROM parts)
{SHOW} {ranked('mixed', 4)}"""

HYBRID = f"""WITH {DENSE_DOCS}, {bm25('corpus', 'queries')},
both_lists AS (SELECT query_id, position, rank FROM {ranked('dense', 20)} UNION ALL SELECT query_id, position, rank FROM {ranked('scored', 20)}),
fused AS (SELECT query_id, position, sum(1.0::DOUBLE / (60 + rank)) AS score FROM both_lists GROUP BY ALL)
{SHOW} {ranked('fused', 4, "position || '::chunk-0'")}"""

WINDOWED = f"""WITH {DENSE_DOCS},
cand AS (SELECT d.query_id, d.position, d.rank AS given, c.text FROM {ranked('dense', 20)} d JOIN corpus c USING (position)),
ct AS (SELECT query_id, position, given, {terms('text')} AS ts FROM cand),
stats AS (SELECT query_id, count(*) AS n, avg(len(ts)) AS average FROM ct GROUP BY query_id),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('text')}) AS term FROM queries) GROUP BY ALL),
tf AS (SELECT query_id, position, length, term, count(*) AS tf FROM (SELECT query_id, position, len(ts) AS length, unnest(ts) AS term FROM ct) GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
lex AS (
  SELECT query_id, position, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))) AS score
  FROM qt JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY ALL),
lexed AS (SELECT lex.*, given FROM lex JOIN cand USING (query_id, position)),
lex_ranked AS (SELECT query_id, position, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, given) AS rank FROM lexed WHERE score > 0),
fused AS (SELECT query_id, position, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, position, rank FROM lex_ranked UNION ALL SELECT query_id, position, given FROM cand) GROUP BY ALL)"""

CASES = """cases AS (
  SELECT doc_id AS query_id, substr(text, 1, 200) AS text, source_path, substr(text, 1, 12) AS k1, substr(text, 21, 30) AS k2, substr(text, 801, 25) AS k3 FROM docs WHERE doc_id % 100 = 0)"""


def hits(size: int = 800, overlap: int = 120, k: int = 4) -> str:
    """WITH list up to ``hits`` of the self-questions over fixed chunks of plain texts."""
    return f"""WITH {texts('fixed')}, {fixed_chunks(size, overlap, headings=False)}, {CASES},
page AS (SELECT row_number() OVER (ORDER BY path, idx) AS position, path, idx, body, a, b, title, concat_ws(' ', nullif(title, ''), nullif(stem, ''), body) AS text FROM chunks),
{bm25('page', 'cases')},
hits AS (SELECT h.query_id, h.rank, h.score, p.path, p.path || '::chunk-' || p.idx AS chunk_id, p.idx, p.a, p.b, p.title, p.body FROM {ranked('scored', k)} h JOIN page p USING (position))"""


BLOCK = "'[S' || rank || ']' || chr(10) || '{source}: ' || path || chr(10) || 'title: ' || title || chr(10) || 'chunk_index: ' || idx || chr(10) || 'start_char: ' || a || chr(10) || 'end_char: ' || b || chr(10) || {more}'{body}: ' || body"
CONTEXT = f"string_agg({BLOCK.format(source='source', more='', body='content')}, chr(10) || chr(10) ORDER BY rank)"
RESULTS = f"""string_agg({BLOCK.format(source='source_path', more="'score: ' || printf('%.4f', score) || chr(10) || ", body='text')}, chr(10) || chr(10) ORDER BY rank)"""
ANSWERS = f"""answers AS (
  SELECT c.query_id, CASE WHEN len(bodies) > 0 THEN 'Provider fallback (missing_api_key); extractive answer: ' || array_to_string(bodies[1:2], ' ')
         ELSE 'I could not find supporting context for: ' || c.text END AS answer
  FROM cases c LEFT JOIN (SELECT query_id, list({strip('body')} ORDER BY rank) AS bodies FROM hits GROUP BY query_id) h USING (query_id))"""


def _has(text: str, keyword: str) -> str:
    return f"contains(lower({text}), lower({keyword}))"


RATES = f"""lists AS (SELECT query_id, list(body ORDER BY rank) AS bodies, list(DISTINCT path) AS paths FROM hits GROUP BY query_id),
asked AS (
  SELECT c.*, a.answer, coalesce(l.bodies, []) AS bodies, coalesce(l.paths, []) AS paths,
         CASE WHEN k1 = '' THEN [] ELSE [k1] END AS e1, CASE WHEN k2 = '' THEN [] ELSE [k2] END AS e2, [k2, k3, 'zzz none'] AS e3
  FROM cases c JOIN answers a USING (query_id) LEFT JOIN lists l USING (query_id)),
rates AS (
  SELECT query_id,
    CASE WHEN len(e1) = 0 THEN 1.0 ELSE len(list_filter(e1, lambda k: {_has('answer', 'k')})) / len(e1)::DOUBLE END AS answer_keyword_hit_rate,
    (list_contains(paths, source_path))::INT::DOUBLE AS retrieval_source_hit_rate,
    len(list_filter(e3, lambda k: len(list_filter(bodies, lambda t: {_has('t', 'k')})) > 0)) / 3.0::DOUBLE AS retrieval_span_hit_rate,
    list_sum(list_transform(e3, lambda k: coalesce(1.0::DOUBLE / list_position(list_transform(bodies, lambda t: {_has('t', 'k')}), true), 0.0))) / 3.0::DOUBLE AS retrieval_reciprocal_rank,
    CASE WHEN len(bodies) = 0 THEN 0.0 ELSE len(list_filter(bodies, lambda t: len(list_filter(e3, lambda k: {_has('t', 'k')})) > 0)) / len(bodies)::DOUBLE END AS retrieval_precision,
    (list_contains(paths, source_path))::INT::DOUBLE AS citation_source_hit_rate,
    CASE WHEN len(e2) = 0 THEN 1.0 ELSE len(list_filter(e2, lambda k: len(list_filter(bodies, lambda t: {_has('t', 'k')})) > 0)) / len(e2)::DOUBLE END AS citation_span_hit_rate
  FROM asked)"""
RATE_NAMES = ("answer_keyword_hit_rate", "retrieval_source_hit_rate", "retrieval_span_hit_rate", "retrieval_reciprocal_rank", "retrieval_precision", "citation_source_hit_rate", "citation_span_hit_rate")
MEANS = ", ".join(f"coalesce(round(avg({r}), 4), 0.0) AS {r}" for r in RATE_NAMES)


def _cell(no: int, size: int, overlap: int, k: int) -> str:
    return f"SELECT {no} AS run_no, 'basic:local:fixed:lexical:rr-none:k{k}:s{size}:o{overlap}' AS label, * FROM ({hits(size, overlap, k)}, {ANSWERS}, {RATES} SELECT {MEANS} FROM rates)"


CELLS = " UNION ALL ".join(_cell(i, *c) for i, c in enumerate(SWEEP))

SNAPSHOTS = f"""WITH {DOCS},
current AS (SELECT doc_id, source_path, text, sha256(text) AS checksum FROM docs WHERE doc_id % 10 <> 0),
before AS (SELECT source_path, old AS text, sha256(old) AS checksum FROM (SELECT doc_id, source_path, CASE WHEN doc_id % 10 = 1 THEN text || ' old' ELSE text END AS old FROM docs WHERE doc_id % 10 <> 2)),
dirty AS (SELECT source_path FROM docs WHERE doc_id % 35 = 3),
planned AS (
  SELECT source_path, CASE WHEN c.source_path IS NULL THEN 'removed' WHEN b.source_path IS NULL OR b.checksum <> c.checksum OR d.source_path IS NOT NULL THEN 'changed' ELSE 'kept' END AS action
  FROM current c FULL JOIN before b USING (source_path) FULL JOIN dirty d USING (source_path))"""


def _changed() -> str:
    old = "SELECT source_path AS path, regexp_extract(source_path, '([^/]*)\\.md$', 1) AS stem, text FROM before"
    new = "SELECT c.source_path AS path, regexp_extract(c.source_path, '([^/]*)\\.md$', 1) AS stem, c.text FROM current c JOIN planned p USING (source_path) WHERE action = 'changed'"
    both = f"both_texts AS (SELECT false AS fresh, * FROM ({old} WHERE source_path NOT IN (SELECT source_path FROM planned WHERE action <> 'kept')) UNION ALL SELECT true, * FROM ({new})), texts AS (SELECT * FROM both_texts WHERE {strip('text')} <> '')"
    return f"{SNAPSHOTS}, {both}, {fixed_chunks(800, 120, headings=False)}"


STATUS = "['ready', 'live', 'unknown', 'fallback']"

SQL = {
    "discover_filter": f"""WITH {DOCS}, paths AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.TXT' WHEN doc_id % 5 = 1 THEN '.html' ELSE '.md' END AS source_path FROM docs)
SELECT source_path FROM paths WHERE (lower(source_path) LIKE '%.md' OR lower(source_path) LIKE '%.txt') AND NOT (source_path LIKE 'src1/%' OR source_path LIKE '%7.md')""",
    "source_checksum": f"WITH {DOCS} SELECT source_path, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS checksum FROM docs",
    **{f"chunk_{s}": chunk_sql(s) for s in SIZES},
    "chunk_stats": " UNION ALL ".join(f"SELECT * FROM ({chunk_ctes(s, *SIZES[s])} SELECT '{s}' AS strategy, count(*) AS chunks, min(length(body))::INT AS shortest, max(length(body))::INT AS longest, sum(length(body))::BIGINT AS total FROM chunks)" for s in SIZES),
    "section_lookup_fixed": f"""WITH {texts('markdown')}, {LINES}, {SECTIONS}, {fixed_chunks(300, 60)}
SELECT path || '::chunk-' || idx AS chunk_id, a::INT AS start_char, title AS section_title, level::INT AS heading_level FROM chunks""",
    "token_stats": f"WITH {DOCS} SELECT doc_id, len({terms('text')})::INT AS n_terms, len(list_distinct({terms('text')}))::INT AS n_distinct FROM docs",
    "term_frequencies": f"WITH {DOCS} SELECT term, count(*)::BIGINT AS total, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM docs) GROUP BY term",
    "hash_embedding": f"WITH {DOCS}, {vectors('docs', 'doc_id', 'v')} SELECT doc_id, slot, round(v, 6) AS value FROM v",
    "dense_topk": f"""WITH pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS position, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, position AS vec_id, round(score, 6) AS score FROM {ranked('pairs', 4)}""",
    "dense_label_precision": f"""WITH pairs AS (SELECT q.vec_id AS query_id, q.label AS ql, d.label AS dl, d.vec_id AS position, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 100 = 0)
SELECT query_id, round(avg((ql = dl)::INT), 6) AS precision, count(*) AS n FROM {ranked('pairs', 10)} GROUP BY query_id""",
    "bm25_topk": f"{BM25_DOCS} {SHOW} {ranked('scored', 4)}",
    "identity_rerank": f"{BM25_DOCS} {SHOW} {ranked('scored', 4)}",
    "document_dense_topk": f"WITH {DENSE_DOCS} {SHOW} {ranked('dense', 4)}",
    "blended_topk": BLENDED,
    "hybrid_rrf_topk": HYBRID,
    "rrf_fuse": f"""WITH {DOCS}, sized AS (SELECT lang AS query_id, doc_id, length(text) AS n, len({terms('text')}) AS m FROM docs),
lists AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM sized UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, doc_id) FROM sized),
fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists WHERE rank <= 50 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 9) AS score FROM {ranked('fused', 10, 'doc_id::VARCHAR')}""",
    "window_rerank": f"""{WINDOWED} {SHOW} {ranked('fused', 4, "position || '::chunk-0'")}""",
    "window_rerank_lexical": f"{WINDOWED} {SHOW} (SELECT * FROM lex_ranked WHERE rank <= 4)",
    "rerank_apply_order": f"""{BM25_DOCS}, hits AS {ranked('scored', 20)},
listed AS (
  SELECT query_id, max(rank) AS most, CASE WHEN query_id % 5 = 0 THEN [] ELSE [(query_id * 3 + 2 * j * j) % 11 FOR j IN range(5)] END AS raw FROM hits GROUP BY query_id),
chosen AS (SELECT query_id, list_filter(raw, lambda x, i: list_position(raw, x) = i AND x BETWEEN 1 AND most) AS nums FROM listed),
moved AS (SELECT h.*, nums, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(list_position(nums, h.rank), 1000000 + h.rank)) AS new_rank FROM hits h JOIN chosen USING (query_id))
SELECT query_id, new_rank::INT AS rank, position AS doc_id, round(CASE WHEN len(nums) > 0 THEN 1.0::DOUBLE / new_rank ELSE score END, 6) AS score,
       CASE WHEN len(nums) > 0 THEN 'live' ELSE 'fallback' END AS rerank_mode, CASE WHEN len(nums) = 0 THEN 'unusable_rerank_output' END AS rerank_reason FROM moved WHERE new_rank <= 6""",
    "lexical_overlap_topk": f"""WITH {DOCS}, q AS (SELECT item_id AS query_id, unnest(list_distinct({terms('text')})) AS term, len(list_distinct({terms('text')})) AS n FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct({terms('text')})) AS term FROM docs),
s AS (SELECT query_id, doc_id, count(*) / n::DOUBLE AS score FROM q JOIN d USING (term) GROUP BY query_id, doc_id, n)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM {ranked('s', 4, 'doc_id')}""",
    "metadata_overlap": f"""WITH {DOCS}, s AS (SELECT doc_id, list_distinct({terms("doc_id || ' ' || source || ' ' || lang")}) AS q, list_distinct({terms('text')}) AS t FROM docs)
SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q)::DOUBLE END, 6) AS overlap FROM s""",
    "chunk_topk": f"{hits()} SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM hits",
    "answer_context": f"{hits()} SELECT query_id, {CONTEXT} AS context FROM hits GROUP BY query_id",
    "tool_results": f"{hits()} SELECT query_id, {RESULTS} AS results FROM hits GROUP BY query_id",
    "citations": f"{hits()} SELECT query_id, string_agg(path, ',' ORDER BY first) AS citations FROM (SELECT query_id, path, min(rank) AS first FROM hits GROUP BY ALL) GROUP BY query_id",
    "citation_spans": f"{hits()} SELECT query_id, 'S' || rank AS source_id, chunk_id, a::INT AS start_char, b::INT AS end_char FROM hits",
    "merge_hits": f"""{hits()}, two AS (SELECT query_id, 1 AS search_no, rank - 1 AS rank, chunk_id FROM hits WHERE rank > 1 UNION ALL SELECT query_id, 2, rank, chunk_id FROM hits),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY search_no, rank) AS s FROM two)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY search_no, rank))::INT AS source_no, chunk_id, search_no FROM one WHERE s = 1""",
    "extractive_answer": f"{hits()}, {ANSWERS} SELECT query_id, answer FROM answers",
    "eval_metrics": f"{hits()}, {ANSWERS}, {RATES} SELECT query_id, {', '.join(f'round({r}, 6) AS {r}' for r in RATE_NAMES)} FROM rates",
    "failure_reasons": f"""{hits()}, {ANSWERS}, {RATES} SELECT query_id, array_to_string(list_filter([
  CASE WHEN retrieval_source_hit_rate < 1 THEN 'retrieval_missed_expected_source' END,
  CASE WHEN retrieval_span_hit_rate < 1 THEN 'retrieval_missed_expected_span' END,
  CASE WHEN retrieval_span_hit_rate >= 1 AND retrieval_reciprocal_rank < 1 THEN 'retrieval_ranked_expected_span_below_first' END,
  CASE WHEN answer_keyword_hit_rate < 1 THEN 'answer_missing_expected_keywords' END,
  CASE WHEN citation_source_hit_rate < 1 THEN 'citation_missed_expected_source' END,
  CASE WHEN citation_span_hit_rate < 1 THEN 'citation_missed_expected_span' END], lambda x: x IS NOT NULL), ',') AS failure_reasons FROM rates""",
    "eval_summary": f"{hits()}, {ANSWERS}, {RATES}, means AS (SELECT count(*) AS num_cases, {MEANS} FROM rates) SELECT *, answer_keyword_hit_rate AS avg_keyword_hit_rate, citation_source_hit_rate AS source_hit_rate, citation_span_hit_rate AS avg_citation_span_hit_rate FROM means",
    "dataset_identity": """
WITH rows AS (
  SELECT 'corpus' AS part, source || '/' || doc_id::VARCHAR || '.md' AS k, sha256(coalesce(text, '')) AS v FROM documents
  UNION ALL SELECT 'cases', item_id::VARCHAR, sha256(coalesce(text, '')) FROM benchmark),
items AS (
  SELECT part, substr(sha256(k), 1, 4) AS bucket, strlen(k)::VARCHAR || ':' || k || strlen(v)::VARCHAR || ':' || v AS item FROM rows),
buckets AS (SELECT part, bucket, sha256(string_agg(item, '' ORDER BY item)) AS d FROM items GROUP BY part, bucket),
parts AS (SELECT part, sha256(string_agg(bucket || d, '' ORDER BY bucket || d)) AS digest FROM buckets GROUP BY part)
SELECT sha256('9:dataset-1' || '64:' || (SELECT digest FROM parts WHERE part = 'corpus') || '64:' || (SELECT digest FROM parts WHERE part = 'cases')) AS identity
""",
    "sweep_leaderboard": f"""SELECT (row_number() OVER (ORDER BY retrieval_reciprocal_rank DESC, retrieval_precision DESC, answer_keyword_hit_rate DESC, citation_span_hit_rate DESC, run_no))::INT AS place,
  label, retrieval_reciprocal_rank, retrieval_precision, citation_span_hit_rate FROM ({CELLS})""",
    "gold_normalise": f"""WITH {DOCS}, own AS (SELECT doc_id, text, (text <> '')::INT AS one FROM docs)
SELECT doc_id, text AS question, CASE WHEN doc_id % 3 < 2 THEN one ELSE 0 END AS n_expected_answer_keywords, CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS n_expected_source_paths,
  CASE WHEN doc_id % 3 <> 1 THEN one ELSE 0 END AS n_expected_span_keywords, CASE WHEN doc_id % 3 = 0 THEN one ELSE 0 END AS n_expected_retrieval_keywords FROM own""",
    "ingest_plan": f"{SNAPSHOTS} SELECT source_path, action, action = 'changed' AS write FROM planned",
    "index_apply": f"{_changed()} SELECT path || '::chunk-' || idx AS chunk_id, a::INT AS start_char, b::INT AS end_char, sha256(body) AS checksum FROM chunks",
    "manifest_update": f"""{_changed()}, ids AS (SELECT path, count(*) AS n, string_agg(path || '::chunk-' || idx, ',' ORDER BY idx) AS ids FROM chunks GROUP BY path)
SELECT c.source_path, c.checksum, coalesce(n, 0)::INT AS n_chunks, coalesce(ids, '') AS chunk_ids FROM current c LEFT JOIN ids ON ids.path = c.source_path""",
    "point_ids": f"""{chunk_ctes('fixed', *SIZES['fixed'])}, h AS (SELECT path || '::chunk-' || idx AS chunk_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(path || '::chunk-' || idx)) AS x FROM chunks)
SELECT chunk_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(x, 17, 2))::INT & 63) | 128)) || substr(x, 19, 2) || '-' || substr(x, 21, 12) AS point_id FROM h""",
    "previews": f"""WITH {DOCS}, f AS (SELECT doc_id, {strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS t FROM docs)
SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE regexp_replace(substr(t, 1, 600), '{WS}+$', '') || '...' END AS preview FROM f""",
    "turn_search": f"""WITH corpus AS (SELECT conv_id * 100000 + turn AS position, text FROM conversations WHERE role <> 'user'), queries AS (SELECT conv_id * 100000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 100 = 0),
{bm25('corpus', 'queries')} SELECT query_id, rank::INT AS rank, position AS found, round(score, 6) AS score FROM {ranked('scored', 4)}""",
    "status_merge": f"""WITH s AS (SELECT conv_id AS key, turn AS nth, role AS provider, length(text) % 4 AS grave, CASE WHEN length(text) % 3 > 0 THEN 'reason_' || (length(text) % 5) END AS reason FROM conversations),
r AS (SELECT key, string_agg(reason, ';' ORDER BY nth) AS reason FROM (SELECT key, reason, min(nth) AS nth FROM s WHERE reason IS NOT NULL GROUP BY key, reason) GROUP BY key),
m AS (SELECT key, max(grave) AS grave, arg_max(provider, nth) AS provider FROM s GROUP BY key)
SELECT key, provider, {STATUS}[grave + 1] AS mode, reason FROM m LEFT JOIN r USING (key)""",
    "degradation_reason": f"""WITH t AS (SELECT conv_id AS cell, turn AS nth, length(text) AS n FROM conversations),
s AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'live' ELSE {STATUS}[n % 4 + 1] END AS chat, CASE WHEN n % 3 = 0 THEN 'live' ELSE {STATUS}[(n + 1) % 4 + 1] END AS emb, {STATUS}[(n + 2) % 4 + 1] AS rr FROM t),
f AS (SELECT cell, nth, unnest([{{'p': 1, 'name': CASE WHEN n % 7 = 0 THEN 'runtime_fallback' END}}, {{'p': 2, 'name': CASE WHEN chat = 'fallback' THEN 'chat_fallback' WHEN chat <> 'live' THEN 'chat_not_live' END}},
  {{'p': 3, 'name': CASE WHEN emb = 'fallback' THEN 'embedding_fallback' WHEN emb <> 'live' THEN 'embedding_not_live' END}},
  {{'p': 4, 'name': CASE WHEN rr = 'ready' AND n % 5 > 0 THEN NULL WHEN rr = 'fallback' THEN 'reranker_fallback' WHEN rr <> 'live' THEN 'reranker_not_live' END}}]) AS x FROM s),
g AS (SELECT cell, x.name AS name, min(nth * 10 + x.p) AS pos FROM f WHERE x.name IS NOT NULL GROUP BY ALL),
r AS (SELECT cell, string_agg(name, ',' ORDER BY pos) AS reason FROM g GROUP BY cell)
SELECT cell, CASE WHEN NOT bool_and(n % 29 > 0) THEN 'missing_diagnostics' ELSE any_value(r.reason) END AS reason FROM t LEFT JOIN r USING (cell) GROUP BY cell""",
}

# Other ways to the same results: stored postings, cells of vectors, a store through changes.
SQL["bm25_stored_topk"] = SQL["bm25_topk"]
SQL["dense_cells_topk"] = SQL["dense_topk"]
SQL["index_store"] = SQL["index_apply"]
SQL["index_statistics"] = f"""WITH {DOCS}, each AS (SELECT doc_id, {terms('text')} AS found FROM docs),
whole AS (SELECT count(*)::BIGINT AS n_chunks, round(avg(len(found)), 6) AS average FROM each)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df, n_chunks, average FROM (SELECT doc_id, unnest(found) AS term FROM each), whole GROUP BY term, n_chunks, average"""

SQL["record_rejects"] = f"""WITH {DOCS} SELECT doc_id, ['', 'not_json', 'not_an_object', 'missing:title', 'type:chunk_index', 'negative:start_char', 'span_reversed', 'metadata_not_object', 'embedding_not_list', 'embedding_item', 'type:text,type:chunk_index', ''][doc_id % 12 + 1] AS reasons,
  CASE WHEN doc_id % 12 IN (0, 11) THEN sha256(text) END AS checksum, CASE WHEN doc_id % 12 = 0 THEN 2 END AS size, CASE WHEN doc_id % 12 = 11 THEN 4 END AS start FROM docs"""


def _default_cells(strategy: str) -> str:
    """The four rankings of one way of chunking, over texts with headings, with their mean rates."""
    lists = {"blended": ranked("mixed", 4), "dense": ranked("dense", 4), "lexical": ranked("scored", 4), "hybrid_rrf": ranked("fused", 4, "chunk_id")}
    head = f"""{chunk_ctes(strategy, 800, 120, "markdown")}, {CASES},
page AS (SELECT row_number() OVER (ORDER BY path, idx) AS position, path || '::chunk-' || idx AS chunk_id, path, body, concat_ws(' ', nullif(title, ''), nullif(title, ''), body) AS text, concat_ws(' ', title, title, stem) AS meta FROM chunks),
{bm25('page', 'cases')},
bodies AS (SELECT position, body AS text FROM page), {vectors('bodies', 'position', 'dv')}, {vectors('cases', 'query_id', 'qv')},
dense AS (SELECT query_id, position, sum(q.v * d.v) AS score FROM qv q JOIN dv d USING (slot) GROUP BY ALL),
sets AS (SELECT position, list_distinct({terms('body')}) AS ts, list_distinct({terms('meta')}) AS ms FROM page),
wants AS (SELECT query_id, list_distinct({terms('text')}) AS qs FROM cases),
pairs AS (
  SELECT a.query_id, s.position, coalesce(d.score, 0) AS dense, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ts)) / len(qs)::DOUBLE END AS lex, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ms)) / len(qs)::DOUBLE END AS meta
  FROM wants a CROSS JOIN sets s LEFT JOIN dense d ON d.query_id = a.query_id AND d.position = s.position),
mixed AS (SELECT query_id, position, greatest(dense, lex, 0.65::DOUBLE * dense + 0.25::DOUBLE * lex + 0.1::DOUBLE * meta) AS score FROM pairs),
two_lists AS (SELECT query_id, position, rank FROM {ranked('dense', 20)} UNION ALL SELECT query_id, position, rank FROM {ranked('scored', 20)}),
fused AS (SELECT query_id, position, any_value(chunk_id) AS chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM two_lists JOIN page USING (position) GROUP BY query_id, position)"""
    taken = " UNION ALL ".join(f"SELECT '{name}' AS ranker, query_id, position, rank FROM {rows}" for name, rows in lists.items())
    # One hit list a ranker and case: the case's id is a pair from here on.
    return f"""{head},
picked AS ({taken}),
every AS (SELECT ranker || '/' || query_id AS query_id, ranker, c.* EXCLUDE (query_id) FROM cases c, (SELECT unnest(['{"', '".join(lists)}']) AS ranker)),
hits AS (SELECT ranker || '/' || query_id AS query_id, rank, path, body FROM picked JOIN page USING (position)),
{ANSWERS.replace('FROM cases c', 'FROM every c')}, {RATES.replace('FROM cases c', 'FROM every c')}
SELECT 'basic:local:{strategy}:' || ranker || ':rr-none:k4:s800:o120' AS label, count(*)::BIGINT AS num_cases, {MEANS}, 'chat_fallback,embedding_fallback' AS reason
FROM rates JOIN (SELECT query_id, ranker FROM every) USING (query_id) GROUP BY ranker"""


SQL["sweep_cells"] = " UNION ALL ".join(f"SELECT * FROM ({_default_cells(s)})" for s in SIZES)

#: Settings of a default cell as JSON with sorted keys, but for the two that differ.
_SETTINGS = """'{"agent_max_turns":6,"backend":"local","candidate_k":20,"chat_model":"","chat_provider":"","chunk_overlap":120,"chunk_size":800,"chunk_strategy":"' || chunking || '","embedding_backoff_ms":800,"embedding_batch":10,"embedding_model":"","embedding_provider":"","embedding_retries":2,"rerank_candidate_k":20,"rerank_provider":"","reranker":"none","retrieval_strategy":"' || ranker || '","rrf_k":60,"runtime":"basic","top_k":4}'"""
SQL["cell_identities"] = f"""SELECT 'basic:local:' || chunking || ':' || ranker || ':rr-none:k4:s800:o120' AS label, sha256('configuration-1' || chr(0) || {_SETTINGS}) AS configuration_identity, identity AS dataset_identity
FROM (SELECT unnest(['fixed', 'paragraph', 'markdown']) AS chunking), (SELECT unnest(['blended', 'dense', 'lexical', 'hybrid_rrf']) AS ranker), ({SQL['dataset_identity']})"""
