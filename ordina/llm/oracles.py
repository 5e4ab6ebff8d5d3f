"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from ordina.llm import jaccard_join, link_rank, quality_rules

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def quality_rules_sql(table: str = "documents", rules: quality_rules.Rules = quality_rules.Rules()) -> str:
    def rate(f: str) -> str:
        weight = f"CASE WHEN v_{f} > 1e-12 THEN greatest(1.0, m_{f} * (1 - m_{f}) / v_{f} - 1) ELSE 1.0 END"
        return f"({f} + m_{f} * {weight}) / (docs + {weight})"

    window = quality_rules.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text, {WORDS} AS ws FROM {table}),
win AS (SELECT rid, i, array_to_string(ws[i:i + {window - 1}], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, range({window}) r(j) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
f AS (SELECT *, n_words < {rules.min_words} AS short, 100 * n_repeat_words > {round(100 * rules.max_repeated)} * n_words AS repeating FROM m),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (short) AS short, count(*) FILTER (repeating) AS repeating FROM f WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT avg(short / docs) AS m_short, var_pop(short / docs) AS v_short, avg(repeating / docs) AS m_repeating, var_pop(repeating / docs) AS v_repeating FROM h),
bad AS (SELECT host FROM h, p WHERE greatest({rate("short")}, {rate("repeating")}) > {rules.max_host_rate})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeating AS base_failed, NOT (short OR repeating) AND coalesce(host NOT IN (SELECT host FROM bad), true) AS kept, host, coalesce(host IN (SELECT host FROM bad), false) AS host_failed FROM f
"""


def jaccard_join_sql(table: str = "documents", how: jaccard_join.Join = jaccard_join.Join()) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM {table}),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, unnest(CASE WHEN len(ws) < {how.n} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {how.n - 2}), lambda i: array_to_string(ws[i:i + {how.n - 1}], ' ')) END) AS sh FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE c >= {how.threshold} * (a.n + b.n - c) - 1e-9),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.other),
k AS (SELECT r.rid, min(o.doc_id) AS class_id FROM r JOIN d o ON o.rid = r.other GROUP BY r.rid)
SELECT d.doc_id, k.class_id, (SELECT count(*) FROM l WHERE l.x = d.rid) AS n_links FROM d JOIN k USING (rid)
"""


ORACLE_SQL = {"op1_quality_rules": quality_rules_sql(), "op9_link_rank": link_rank.judge_sql(), "op10_jaccard_join": jaccard_join_sql()}
