"""The same results as ``queries`` in plain SQL, written for clarity and small data."""

from __future__ import annotations

from gazewatch import fixed
from gazewatch.catalog import gazette
from gazewatch.catalog import queries as Q
from gazewatch.functions.text import SHORTHANDS, portable


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _trim(expr: str) -> str:
    return f"trim({expr}, {_text(fixed.WHITE_SPACE)})"


def _extract(expr: str, pattern: str) -> str:
    return f"regexp_extract({expr}, {_text('(?i)(' + portable(pattern) + ')')}, 1)"


def _rules(name: str, rules) -> str:
    rows = ",\n  ".join(
        f"({i}, {_text(r.nome)}, {_text(r.secao)}, {_text(r.orgao)}, "
        f"[{', '.join(_text(k) for k in r.keywords)}])"
        for i, r in enumerate(rules)
    )
    return f"""{name} AS (
  SELECT * FROM (VALUES
  {rows}) AS v(filter_ord, nome, secao, orgao, keywords)),
keywords AS (
  SELECT r.filter_ord, r.nome, r.secao, CAST(p.i - 1 AS INT) AS keyword_ord, r.keywords[p.i] AS keyword
  FROM {name} r, LATERAL (SELECT unnest(range(1, len(r.keywords) + 1)) AS i) p)"""


ACTS = f"""acts AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%Y') AS yy, strftime(o_orderdate, '%m') AS mm,
    '0' || CAST(1 + day(o_orderdate) % 3 AS VARCHAR) AS dd, CAST(o_custkey % 3 + 1 AS VARCHAR) AS sec,
    month(o_orderdate) AS m, o_orderpriority AS p, o_orderstatus AS st,
    CASE o_orderkey % 8 WHEN 2 THEN 'zipE' WHEN 3 THEN 'pdf' WHEN 6 THEN 'zipE' WHEN 7 THEN 'pdfA'
      ELSE 'zip' END AS v
  FROM orders),
named AS (
  SELECT *, 'DO' || sec AS secao, CAST(yy || '-' || mm || '-' || dd AS DATE) AS edition_date,
    CASE v WHEN 'zip' THEN yy || '-' || mm || '-' || dd || '-DO' || sec || '.zip'
      WHEN 'zipE' THEN yy || '-' || mm || '-' || dd || '-DO' || sec || 'E.zip'
      WHEN 'pdf' THEN yy || '_' || mm || '_' || dd || '_ASSINADO_do' || sec || '.pdf'
      ELSE yy || '_' || mm || '_' || dd || '_ASSINADO_do' || sec || '_extra_A.pdf' END AS file_name
  FROM acts WHERE NOT (m % 4 = 0 AND v IN ('zip', 'zipE'))),
files AS (SELECT DISTINCT file_name, secao, edition_date FROM named),
blocks AS (
  SELECT file_name, secao, edition_date, k, 0 AS part,
    CASE k % 5 WHEN 0 THEN 'DECISÃO SUROD' WHEN 1 THEN 'PORTARIA ANTT' WHEN 2 THEN 'DELIBERAÇÃO DG'
      WHEN 3 THEN 'INSTRUÇÃO NORMATIVA SUFER' ELSE 'RETIFICAÇÃO DA PORTARIA' END
    || ' Nº ' || CAST(k % 9 + 1 AS VARCHAR) || ', DE ' || dd || ' DE '
    || split_part('{gazette.MONTHS}', ',', m) || ' DE ' || yy AS line
  FROM named WHERE k % 3 = 0
  UNION ALL
  SELECT file_name, secao, edition_date, k, 1,
    CASE WHEN p = '1-URGENT' THEN 'A Agência Nacional de Transportes Terrestres resolve'
      WHEN p = '5-LOW' THEN 'A Diretoria Colegiada resolve' ELSE 'Texto do ato' END
    || ' ' || CASE st WHEN 'F' THEN 'SUFER' WHEN 'O' THEN 'portaria e deliberação' ELSE 'retificação' END
    || ' item ' || CAST(k AS VARCHAR)
  FROM named),
plain_lines AS (
  SELECT file_name, secao, edition_date, line,
    row_number() OVER (PARTITION BY file_name ORDER BY k, part) - 1 AS line_no,
    count(*) OVER (PARTITION BY file_name) AS n_lines
  FROM blocks)"""

DOCUMENTS = """plain_lines AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file_name, lang AS secao, DATE '2024-01-01' AS edition_date,
    CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line, len(parts) AS n_lines
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS i) p)"""


def _titles(patterns=fixed.TITLE_PATTERNS) -> str:
    tries = ",\n      ".join(f"nullif({_extract('s', p)}, '')" for p in patterns)
    return f"""titled AS (
  SELECT * EXCLUDE (s), CASE WHEN line_no >= 1 THEN {_trim(f"coalesce({tries})")} END AS title
  FROM (SELECT *, {_trim('line')} AS s FROM plain_lines))"""


def _bounds(back: int = Q.BACK, forward: int = Q.FORWARD, unit: str = "file_name") -> str:
    return f"""ends AS (
  SELECT *, min(CASE WHEN title IS NOT NULL THEN line_no END) OVER (PARTITION BY {unit}
    ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND {forward - 1} FOLLOWING) AS next_title
  FROM titled),
starts AS (
  SELECT *, last_value(CASE WHEN title IS NOT NULL THEN line_no END IGNORE NULLS) OVER (
    PARTITION BY {unit} ORDER BY line_no ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW) AS title_line
  FROM ends),
hits AS (
  SELECT s.file_name, s.secao, s.edition_date, s.n_lines, s.line_no, s.next_title, s.title_line,
    o.title AS opening_title, o.next_title AS opening_next, k.filter_ord, k.nome, k.keyword_ord, k.keyword
  FROM starts s JOIN keywords k ON k.secao = s.secao AND contains(lower(s.line), lower(k.keyword))
  LEFT JOIN ends o ON o.file_name = s.file_name AND o.line_no = s.title_line)"""


GATE = """gate AS (
  SELECT DISTINCT l.file_name, r.filter_ord FROM plain_lines l
  JOIN rules r ON r.secao = l.secao AND contains(lower(l.line), lower(r.orgao)))"""


def _texts(gated: bool = True) -> str:
    gate = "WHERE (file_name, filter_ord) IN (SELECT (file_name, filter_ord) FROM gate)"
    full = _trim("string_agg(l.line, chr(10) ORDER BY l.line_no)")
    return f"""bounds AS (
  SELECT *, coalesce(title_line, line_no) AS start_line,
    coalesce(CASE WHEN title_line IS NULL THEN next_title ELSE opening_next END, n_lines) AS end_line
  FROM hits {gate if gated else ''}),
texts AS (
  SELECT b.file_name, b.start_line, b.end_line, {full} AS full_text
  FROM (SELECT DISTINCT file_name, start_line, end_line FROM bounds) b
  JOIN plain_lines l ON l.file_name = b.file_name AND l.line_no >= b.start_line AND l.line_no < b.end_line
  GROUP BY b.file_name, b.start_line, b.end_line),
labelled AS (
  SELECT b.*, t.full_text,
    coalesce(opening_title, {_trim("replace(substr(t.full_text, 1, 200), chr(10), ' ')")}) AS title
  FROM bounds b JOIN texts t USING (file_name, start_line, end_line)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_name, filter_ord, keyword_ord, title ORDER BY line_no) AS nth
  FROM labelled)"""


def _columns(line_no: str = "line_no") -> str:
    found = _extract("title", fixed.DATE_PHRASE)
    return f"""edition_date, filter_ord, nome AS filter_name, file_name AS source_file, keyword_ord,
  keyword AS keyword_hit, {line_no} AS line_no, title AS publication_title,
  CASE WHEN title_line IS NULL THEN '' ELSE {found} END AS publication_date,
  substr(full_text, 1, 500) AS text_snippet, full_text"""


def _search(*, base: str = ACTS, rules=gazette.RULES, patterns=fixed.TITLE_PATTERNS, unit: str = "file_name") -> str:
    parts = [base, _rules("rules", rules), _titles(patterns), _bounds(unit=unit), GATE, _texts()]
    return ",\n".join(parts) + f",\nmatches AS (SELECT {_columns()} FROM ranked WHERE nth = 1)"


MATCHES = "WITH " + _search()
HITS = "WITH " + ",\n".join([ACTS, _rules("rules", gazette.RULES), _titles(), _bounds()])
RULES = "WITH " + ",\n".join([ACTS, _rules("rules", gazette.RULES)])
FILES = "WITH " + ACTS
DOCUMENT_RULES = "WITH " + _rules("rules", Q.DOCUMENT_RULES)
PREFERRED = """(SELECT * FROM (SELECT *, CASE WHEN file_name LIKE '%.zip' THEN 'zip' ELSE 'pdf' END AS kind,
  max(CASE WHEN file_name LIKE '%.zip' THEN 1 ELSE 0 END) OVER (PARTITION BY edition_date, secao) AS z FROM files)
  WHERE (z = 1) = (kind = 'zip'))"""
LEDGER = f"(SELECT * FROM files WHERE edition_date < DATE '{Q.LEDGER_BEFORE}')"
IN_WINDOW = f"edition_date BETWEEN DATE '{Q.TARGET}' - 2 AND DATE '{Q.TARGET}'"

_heading = (
    f"CASE WHEN publication_title = '' THEN '{fixed.NO_TITLE_LABEL}' ELSE publication_title END"
    " || CASE WHEN publication_date <> '' THEN ' — ' || publication_date ELSE '' END"
)
_numbered = f"""numbered AS (
  SELECT *, edition_date AS run_date, count(*) OVER (PARTITION BY edition_date) AS n_matches,
    row_number() OVER (PARTITION BY edition_date
      ORDER BY filter_ord, edition_date, source_file, keyword_ord, line_no) AS n,
    {_heading} AS heading
  FROM matches)"""
_kw = _text(Q.KEYWORD)
_every = f"""(SELECT doc_id, text, i - 1 AS position FROM (
  SELECT doc_id, text, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM documents) d
  WHERE substr(t, i, {len(Q.KEYWORD)}) = {_kw})"""
_pages = f"""kept AS (
  SELECT conv_id, turn, {_trim('text')} AS text FROM conversations WHERE {_trim('text')} <> '')"""
_beat = "(isodow(run_ts) <= 5 AND hour(run_ts) >= 9 AND hour(run_ts) < 11)"


def _restricted(condition: str) -> str:
    """Matches in the chosen files only; files do not influence each other."""
    return f"SELECT * FROM matches WHERE source_file IN (SELECT file_name FROM {condition})"


# Lines are numbered in the file; an entry's last line stands for that of the file.
ENTRIES = """placed AS (
  SELECT conv_id, turn, string_split(text, chr(10)) AS parts,
    coalesce(sum(len(string_split(text, chr(10))) + 1) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM kept),
plain_lines AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS file_name, turn AS entry, 'DO1' AS secao, DATE '2024-01-01' AS edition_date,
    CAST(base + i - 1 AS BIGINT) AS line_no, parts[i] AS line, CAST(base + len(parts) AS BIGINT) AS n_lines
  FROM placed p, LATERAL (SELECT unnest(range(1, len(p.parts) + 1)) AS i) x)"""


def _spelled(expr: str) -> str:
    for digit, syllable in enumerate(Q.SYLLABLES):
        expr = f"replace({expr}, '{digit}', '{syllable}')"
    return expr


def _listed(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _portable(expr: str) -> str:
    """The shorthands of a pattern in a column, spelled out."""
    for shorthand, spelled in SHORTHANDS:
        expr = f"replace({expr}, {_text(shorthand)}, {_text(spelled)})"
    return expr


ORACLE: dict[str, str] = {
    "all_matches": f"{MATCHES} SELECT * FROM matches",
    "publications": "WITH "
    + ",\n".join([ACTS, _rules("rules", gazette.RULES), _titles(), _bounds(), _texts(gated=False)])
    + f""" SELECT {_columns('min(line_no)')} FROM ranked
    GROUP BY edition_date, filter_ord, nome, file_name, keyword_ord, keyword, title, title_line,
      start_line, full_text""",
    "dedup_by_title": f"""{MATCHES} SELECT file_name, secao, edition_date, filter_ord, keyword, title, line_no,
      start_line, end_line, title_line IS NOT NULL AS is_titled FROM ranked WHERE nth = 1""",
    "document_matches": "WITH "
    + _search(base=DOCUMENTS, rules=Q.DOCUMENT_RULES, patterns=Q.DOCUMENT_TITLES)
    + " SELECT * FROM matches",
    "entry_scoped_matches": "WITH "
    + _search(base=f"{_pages},{ENTRIES}", rules=Q.ENTRY_RULES, patterns=Q.ENTRY_TITLES, unit="file_name, entry")
    + " SELECT * FROM matches",
    "asof_title_back": f"""{HITS} SELECT file_name, filter_ord, keyword_ord, line_no, title_line,
      opening_title AS title FROM hits""",
    "asof_title_next": f"{HITS} SELECT file_name, filter_ord, keyword_ord, line_no, next_title FROM hits",
    "extract_title": f"""WITH {ACTS}, {_titles()}
      SELECT file_name, line_no, title FROM titled WHERE title IS NOT NULL""",
    "title_date": f"""WITH {ACTS}, {_titles()} SELECT file_name, line_no, title,
      {_extract('title', fixed.DATE_PHRASE)} AS publication_date FROM titled WHERE title IS NOT NULL""",
    "keyword_line_hits": f"""{RULES} SELECT l.file_name, l.line_no, k.filter_ord, k.keyword FROM plain_lines l
      JOIN keywords k ON k.secao = l.secao AND contains(lower(l.line), lower(k.keyword))""",
    "keyword_index_hits": f"""WITH {DOCUMENTS}, spelled AS (
      SELECT p_partkey, {_spelled("lpad(CAST(p_partkey AS VARCHAR), 4, '0')")} AS w FROM part),
    listed AS (
      SELECT CAST(p_partkey AS INT) AS filter_ord, {_listed(Q.LANGUAGES)}[p_partkey % {len(Q.LANGUAGES)} + 1] AS secao,
        [CAST(p_partkey AS VARCHAR), right(w, 6), right(w, 8), right(w, 6) || ' ', right(w, 6) || '.', ' ' || right(w, 8)] AS kws
      FROM spelled),
    wanted AS (
      SELECT filter_ord, secao, CAST(unnest(range(0, 6)) AS INT) AS keyword_ord, unnest(kws) AS keyword FROM listed),
    met AS (
      SELECT l.file_name, l.line_no, l.secao, k.keyword FROM plain_lines l
      JOIN (SELECT DISTINCT secao, keyword FROM wanted) k ON k.secao = l.secao AND contains(lower(l.line), k.keyword))
    SELECT m.file_name, m.line_no, w.filter_ord, w.keyword_ord, w.keyword FROM met m JOIN wanted w USING (secao, keyword)""",
    "regex_keyword_hits": f"""WITH {ACTS}, {_rules("rules", Q.PATTERN_RULES)}
      SELECT l.file_name, l.line_no, k.filter_ord, k.keyword FROM plain_lines l JOIN keywords k ON k.secao = l.secao
        AND CASE WHEN k.keyword LIKE 're:%' THEN regexp_matches(l.line, '(?i)' || {_portable("substr(k.keyword, 4)")})
          ELSE contains(lower(l.line), lower(k.keyword)) END""",
    "org_gate": f"{RULES}, {GATE} SELECT * FROM gate",
    "org_theta_join": f"""{DOCUMENT_RULES} SELECT d.doc_id, r.secao, r.nome, r.orgao FROM documents d
      JOIN rules r ON r.secao = d.lang AND contains(lower(d.text), lower(r.orgao))""",
    "keyword_any_filter": "SELECT doc_id, text FROM documents WHERE "
    + " OR ".join(f"contains(lower(text), {_text(k)})" for k in Q.KEYWORDS),
    "keyword_count": f"""SELECT doc_id, CAST((SELECT count(*) FROM (SELECT unnest(range(1, length(t) + 1)) AS i)
      WHERE substr(t, i, {len(Q.KEYWORD)}) = {_kw}) AS INT) AS n
      FROM (SELECT doc_id, lower(text) AS t FROM documents) d""",
    "keyword_positions": f"""SELECT doc_id, i - 1 AS position FROM (
      SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM documents) d
      WHERE substr(t, i, {len(Q.KEYWORD)}) = {_kw}""",
    "context_snippet": f"""SELECT doc_id, position, substr(text, greatest(position - 250, 0) + 1,
      position + 250 - greatest(position - 250, 0)) AS snippet FROM {_every}""",
    "locate_line": f"""SELECT doc_id, position, len(string_split(substr(text, 1, position), chr(10))) - 1 AS line_no
      FROM {_every}""",
    "line_offsets": """SELECT doc_id, line_no, length(line) AS n_chars,
      CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_offset
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)""",
    "doc_lines": """SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no,
      unnest(string_split(text, chr(10))) AS line FROM documents""",
    "strip_markup": f"""SELECT page_id, text FROM (SELECT page_id, {_trim(
        f"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), {_text(portable(r'\s+'))}, ' ', 'g')"
    )} AS text FROM pages) WHERE text <> ''""",
    "paged_text_assemble": f"""WITH {_pages} SELECT conv_id, turn,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
      CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins, text FROM kept""",
    "paged_text_lines": f"""WITH {_pages}, whole AS (
      SELECT conv_id, string_split(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10)) AS parts
      FROM kept GROUP BY conv_id)
      SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS file_name, len(parts) AS n_lines,
        unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line FROM whole""",
    "listing_extract": f"""{FILES} SELECT CAST(date_trunc('month', edition_date) AS DATE) AS edition_date, secao,
      file_name FROM files WHERE secao IN ('DO1', 'DO3')""",
    "listing_union_distinct": " UNION ".join(
        f"SELECT unnest(regexp_extract_all(html, {_text(p)}, 1)) AS name FROM pages"
        for p in Q.LINK_PATTERNS
    ),
    "file_kind_split": f"{FILES} SELECT *, CASE WHEN file_name LIKE '%.zip' THEN 'zip' ELSE 'pdf' END AS kind FROM files",
    "section_filter": f"{FILES} SELECT * FROM files WHERE secao = 'DO2'",
    "prefer_zip": f"{FILES} SELECT edition_date, secao, file_name, kind FROM {PREFERRED}",
    "new_files_anti": f"{FILES} SELECT * FROM files WHERE file_name NOT IN (SELECT file_name FROM {LEDGER})",
    "processed_semi": f"{FILES} SELECT * FROM files WHERE file_name IN (SELECT file_name FROM {LEDGER})",
    "ledger_upsert": f"{FILES} SELECT file_name, edition_date AS processed_date FROM files",
    "matches_committed": f"""{MATCHES} SELECT source_file, 'run-' || strftime(edition_date, '%Y-%m') AS run_id,
      filter_name, keyword_hit, line_no FROM matches WHERE edition_date < DATE '{Q.LEDGER_BEFORE}'""",
    "filter_section_join": f"""{RULES} SELECT f.*, r.filter_ord, r.nome, r.orgao FROM files f JOIN rules r
      ON r.secao = f.secao""",
    "claim_all_filters": f"{RULES} SELECT f.file_name, r.filter_ord FROM files f JOIN rules r ON r.secao = f.secao",
    "claim_first_filter": f"""{RULES} SELECT f.file_name, min(r.filter_ord) AS filter_ord FROM files f
      JOIN rules r ON r.secao = f.secao GROUP BY f.file_name""",
    "filters_explode": """SELECT CAST(p_partkey AS INT) AS filter_ord, p_brand AS nome, p_type AS secao,
      CAST(unnest(range(0, len(string_split(p_name, ' ')))) AS INT) AS keyword_ord,
      unnest(string_split(p_name, ' ')) AS keyword FROM part""",
    "filter_date_grid": f"""{RULES} SELECT f.secao, f.target_date, r.filter_ord, r.nome,
      CAST(f.target_date - d.back AS DATE) AS check_date
      FROM (SELECT DISTINCT secao, edition_date AS target_date FROM files) f
      JOIN rules r ON r.secao = f.secao, (SELECT unnest([0, 1, 2]) AS back) d""",
    "lookback_window": f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
      WHERE o_orderdate BETWEEN DATE '{Q.DAY}' - 30 AND DATE '{Q.DAY}'""",
    "exact_day": f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
      WHERE CAST(o_orderdate AS DATE) = DATE '{Q.DAY}'""",
    "date_spine": """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders),
      spine AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM days)
      SELECT s.day, count(d.day) AS n_orders FROM spine s LEFT JOIN days d ON d.day = s.day GROUP BY s.day""",
    "recent_matches": f"""SELECT event_id, ts, event_type FROM events
      WHERE ts >= DATE '{Q.AS_OF}' - 30 ORDER BY ts DESC""",
    "heartbeat_window": f"SELECT event_id, ts, {_beat.replace('run_ts', 'ts')} AS is_heartbeat FROM events",
    "distinct_sections": f"""{FILES} SELECT string_agg(secao, ', ' ORDER BY secao) AS sections
      FROM (SELECT DISTINCT secao FROM files)""",
    "digest_numbered": f"""{MATCHES}, {_numbered} SELECT run_date, n, n_matches, filter_name, source_file,
      keyword_hit, heading FROM numbered""",
    "digest": f"""{MATCHES}, {_numbered} SELECT DISTINCT run_date, n_matches,
      '{Q.PREFIX} ' || CAST(run_date AS VARCHAR) || ' — ' || CAST(n_matches AS VARCHAR) || ' achado(s)' AS subject,
      '<html><body><h2>{Q.PREFIX} ' || CAST(run_date AS VARCHAR) || '</h2><p><b>{fixed.TOTAL_LABEL} '
        || CAST(n_matches AS VARCHAR) || '</b></p>' AS head,
      '<hr/><p>{fixed.WINDOW_LABEL} D-2, D-1, D+0 | Seções: DO1, DO2</p></body></html>' AS foot FROM numbered""",
    "digest_items": f"""{MATCHES}, {_numbered} SELECT run_date, n, '<hr/><h3>{fixed.ITEM_LABEL}' || CAST(n AS VARCHAR)
        || ' — ' || heading || '</h3><p><b>{fixed.FILTER_LABEL}</b> ' || filter_name
        || '</p><p><b>{fixed.KEYWORD_LABEL}</b> <code>' || keyword_hit || '</code></p><p><b>{fixed.SOURCE_LABEL}</b> '
        || source_file || '</p><pre>' || text_snippet || '</pre>' AS block FROM numbered""",
    "digest_decision": f"""WITH runs AS (SELECT date_trunc('hour', ts) AS run_ts,
        count(*) FILTER (event_type = 'purchase') AS n_matches FROM events GROUP BY 1),
      due AS (SELECT *, n_matches > 0 OR {_beat} AS emit FROM runs)
      SELECT strftime(run_ts, '%Y-%m-%d %H') AS run_hour, n_matches, emit,
        CASE WHEN emit THEN '{Q.PREFIX} ' || strftime(run_ts, '%Y-%m-%d') || ' — ' || CASE WHEN n_matches > 0
          THEN CAST(n_matches AS VARCHAR) || ' achado(s)' ELSE '{fixed.HEARTBEAT_LABEL} (0 achados)' END END AS subject,
        CASE WHEN emit AND n_matches = 0 THEN '<html><body><h2>{Q.PREFIX} ' || strftime(run_ts, '%Y-%m-%d')
          || '</h2><p><b>{fixed.HEARTBEAT_LABEL}</b></p><p>{fixed.NO_MATCH_LABEL}</p></body></html>' END AS body
      FROM due""",
    "matches_per_filter": f"{MATCHES} SELECT filter_name, count(*) AS total FROM matches GROUP BY 1",
    "matches_per_period": f"""{MATCHES} SELECT unit, CAST(date_trunc(unit, edition_date) AS DATE) AS period, filter_name,
      count(*) AS total FROM matches, (SELECT unnest(['day', 'week', 'month']) AS unit) GROUP BY ALL""",
    "match_row_ids": f"""{MATCHES} SELECT 1000 + row_number() OVER (
        ORDER BY edition_date, filter_ord, source_file, keyword_ord, line_no) AS id,
      edition_date, filter_name, source_file, keyword_hit, line_no FROM matches""",
    "run_for_date": f"{MATCHES} "
    + _restricted(
        f"{PREFERRED} WHERE {IN_WINDOW} AND file_name NOT IN (SELECT file_name FROM {LEDGER})"
    ),
    "run_summary": f"""{MATCHES}, chosen AS (SELECT * FROM {PREFERRED}), found AS ({_restricted('chosen')})
      SELECT c.edition_date AS run_date, count(DISTINCT c.file_name) AS files_processed,
        (SELECT count(*) FROM found f WHERE f.edition_date = c.edition_date) AS matches_found,
        CAST(0 AS INT) AS email_sent,
        'Sem lookback (backfill), ' || CAST(count(DISTINCT c.file_name) AS VARCHAR) || ' arquivo(s) processado(s)'
          AS notes
      FROM chosen c GROUP BY c.edition_date""",
    "backfill_rollup": f"""{MATCHES}, chosen AS (SELECT * FROM {PREFERRED}), found AS ({_restricted('chosen')}),
      days AS (SELECT CAST(unnest(generate_series(DATE '{Q.RANGE[0]}', DATE '{Q.RANGE[1]}', INTERVAL 1 DAY)) AS DATE)
        AS day)
      SELECT d.day, count(f.source_file) AS matches_found, CAST(0 AS INT) AS is_total
      FROM days d LEFT JOIN found f ON f.edition_date = d.day GROUP BY d.day
      UNION ALL SELECT NULL, count(*), 1 FROM found""",
}
