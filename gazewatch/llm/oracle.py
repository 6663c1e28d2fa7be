"""SQL that gives the same rows as the query of the same name, where SQL can express it."""

from __future__ import annotations

from gazewatch.llm.quality import STOP_WORDS

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE["op10_quality_rules"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i : i + 7], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) > 8)
), places AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), repeats AS (
    SELECT r, sum(least(8, coalesce(next - i, 8))) AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM places) GROUP BY r
), measured AS (
    SELECT doc_id, len(words) AS n_words,
        len(array_to_string(words, '')) AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
        len(list_filter(words, lambda w: rtrim(lower(w), '.,;:!?') IN ({_STOPS}))) AS stops,
        coalesce(repeats.n, 0) AS n_repeat_words
    FROM docs LEFT JOIN repeats USING (r)
), judged AS (
    SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
    n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.25
        AND stops / n_words >= 0.05 AND n_dup_lines / len(lines) <= 0.6 AS kept
FROM judged
"""

ORACLE["op1_difference_cover_dedup"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i : i + 34], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)
), repeats AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1
), gone AS (
    SELECT r, list_sort(list(DISTINCT p)) AS places
    FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM repeats) GROUP BY r
), words AS (
    SELECT r, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS w FROM docs
), left_over AS (
    SELECT r, string_agg(w, ' ' ORDER BY p) AS kept
    FROM words ANTI JOIN (SELECT r, unnest(places) AS p FROM gone) USING (r, p) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (r) LEFT JOIN left_over USING (r)
"""

ORACLE["op9_suffix_array_dedup"] = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
    SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS s
    FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs WHERE len(h) >= 400)
), repeats AS (
    SELECT r, i FROM strings QUALIFY count(*) OVER (PARTITION BY s) > 1
), spans AS (
    SELECT r, min(i) AS low, max(i) + 200 AS high
    FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM (
        SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new
        FROM repeats))
    GROUP BY r, span
), ends AS (
    SELECT r, low, high, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low) AS begin FROM spans
), parts AS (
    SELECT r, begin AS place, substring(h, 2 * begin + 1, 2 * (low - begin)) AS part
    FROM ends JOIN docs USING (r)
    UNION ALL
    SELECT r, tail, substring(h, 2 * tail + 1)
    FROM docs JOIN (SELECT r, max(high) AS tail FROM spans GROUP BY r) USING (r)
), left_over AS (
    SELECT r, string_agg(part, '' ORDER BY place) AS kept FROM parts GROUP BY r
), counts AS (
    SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed FROM spans GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN counts USING (r) LEFT JOIN left_over USING (r)
"""

ORACLE["op2_odd_sketch_dedup"] = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i
        FROM docs WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other
), least_id AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least_id USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLE["op11_chunk_memo_fim"] = """
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), draws AS (
    SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM docs
), cuts AS (
    SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM draws
), parts AS (
    SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""

ORACLE["op12_fair_queue_mix"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS})::BIGINT AS size,
        substr(sha256('12:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS drawn
    FROM documents
), sources AS (
    SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS budget
    FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
        FROM docs GROUP BY source)
), tried AS (
    SELECT *, budget - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
    FROM sources WINDOW w AS (ORDER BY 3.0 * source_size / weight, number)
), limits AS (
    SELECT *, weight::DOUBLE * rest::DOUBLE / shares::DOUBLE > 3 * source_size AS above FROM tried
), targets AS (
    SELECT source, source_size, number, budget, CASE WHEN above THEN (3 * source_size)::DOUBLE
        ELSE weight::DOUBLE * (budget - coalesce(sum(CASE WHEN above THEN 3 * source_size END) OVER (), 0))::DOUBLE
            / (sum(CASE WHEN NOT above THEN weight END) OVER ())::DOUBLE END AS target
    FROM limits
), placed AS (
    SELECT r, doc_id, size, source_size, number, budget, target,
        coalesce(sum(size) OVER (PARTITION BY number ORDER BY drawn, doc_id, size, r
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), epochs AS (
    SELECT *, unnest([0, 1, 2]) AS epoch FROM placed WHERE size > 0
), entries AS (
    SELECT *, unnest(range(0, size, 1024)) AS first FROM epochs
), timed AS (
    SELECT r, number, budget, target, start + epoch * source_size + first AS served, least(1024, size - first) AS words
    FROM entries
), merged AS (
    SELECT r, words, budget - coalesce(sum(words) OVER (ORDER BY (served + words)::DOUBLE / target, number, served
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
    FROM timed
), mixed AS (
    SELECT r, sum(least(words, room)) AS taken FROM merged WHERE room > 0 GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN mixed USING (r)
"""
