"""DuckDB SQL for the queries that SQL can express."""

import re

from palisade.llm.licenses import TEMPLATES

_RULES = """(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(verdict, rule_host, rule_path)"""

_URLS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut
), keyed AS (SELECT *, row_number() OVER () AS k FROM parts
), fit AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM keyed JOIN {_RULES} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path,
    '(?s)(\\.exe$|/wp-login\\.php$|/cart/|^ads\\.|^[^/]*\\.ads\\.|/track/|/login/)') THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN fit USING (k)"""

_MIX = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2 AS clamp FROM s
), r AS (SELECT *, clamp / weight AS ratio FROM w
), t AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 150 - CAST(coalesce(sum(clamp) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 100)
         / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 100) AS level FROM r
), g AS (
  SELECT place, source, source_size, least(CAST(clamp AS DOUBLE), max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM t
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g
), o AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, d.key,
         e.target - e.whole * e.source_size AS rest,
         sum(d.size) OVER (PARTITION BY e.place ORDER BY d.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
         sum(d.size) OVER (PARTITION BY e.place, d.key) AS own
  FROM sized d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN up_to - own + own / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o"""



def _regex(wording: str) -> str:
    """A template as a regular expression over a line of words, each with a blank behind it."""
    parts = re.findall(r"\[[^\]]*\]|\{\d+\}|[^\s\[\]{}]+", wording)
    some = lambda token: f"([^ ]+ ){{0,{token.strip('{}')}}}" if token[0] == "{" else f"{token} "
    return " " + "".join("(" + "".join(map(some, p.strip("[]").split())) + ")?" if p[0] == "[" else some(p) for p in parts)


_OWN = ",\n".join(f"      CASE WHEN regexp_matches(line, '{_regex(wording)}') THEN '{label}' END" for label, wording in TEMPLATES)
_LICENSES = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), f AS (
  SELECT doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS flat, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w
), c AS (
  SELECT *, [x FOR x IN [' mit  license ', ' apache  license ', ' general  public  license '] IF contains(flat, x)] AS hit,
    [l FOR l IN [
      CASE WHEN contains(flat, ' apache  license ') THEN 'apache' END, CASE WHEN contains(flat, ' general  public  license ') THEN 'gpl' END,
      CASE WHEN contains(flat, ' mit  license ') THEN 'mit' END] IF l IS NOT NULL] AS base,
    list_distinct([l FOR l IN [
{_OWN}
    ] IF l IS NOT NULL]) AS own
  FROM f
)
SELECT doc_id, n_words,
  CAST(coalesce(list_sum([(length(flat) - length(replace(flat, x, ''))) // length(x) FOR x IN hit]), 0) AS BIGINT) AS n_base,
  list_min([len(string_split(trim(substr(flat, 1, instr(flat, x) - 1)), '  ')) - CASE WHEN instr(flat, x) = 1 THEN 1 ELSE 0 END FOR x IN hit]) AS first_word,
  list_max([n_words - len(string_split(trim(string_split(flat, x)[-1]), '  ')) + CASE WHEN trim(string_split(flat, x)[-1]) = '' THEN 1 ELSE 0 END
    - len(string_split(trim(x), '  ')) FOR x IN hit]) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_concat(base, own)), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM c"""



def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Vector codes, with every part compared with every entry in every round."""
    apart = "CAST(list_sum(list_transform(list_zip(v, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT)"
    assign = "SELECT k, p, min({{'apart': {apart}, 'e': e}}) AS best FROM parts JOIN c{i} USING (p) GROUP BY k, p"
    step = """, a{i} AS MATERIALIZED ({assign}
), s{i} AS (
  SELECT p, best.e, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS n FROM a{i} JOIN parts USING (k, p), range(1, size + 1) t(i) GROUP BY ALL
), c{j} AS MATERIALIZED (
  SELECT p, e, list(coalesce((total - ((total % n) + n) % n) // n, c[i]) ORDER BY i) AS c
  FROM (SELECT p, e, c, i FROM c{i}, range(1, len(c) + 1) t(i)) LEFT JOIN s{i} USING (p, e, i) GROUP BY p, e
)"""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, len(embedding) // {parts} AS size,
         list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (SELECT k, p, size, x[p * size + 1 : (p + 1) * size] AS v FROM kept, range({parts}) t(p)
), c0 AS MATERIALIZED (SELECT p, k - 1 AS e, v AS c FROM parts WHERE k <= {entries}
)"""
    for i in range(rounds):
        sql += step.format(i=i, j=i + 1, assign=assign.format(apart=apart, i=i))
    return sql + f""", last AS ({assign.format(apart=apart, i=rounds)}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.apart) AS BIGINT) AS error
  FROM last JOIN kept USING (k) GROUP BY k, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded"""


ORACLE = {"op6_url_filters": _URLS, "op8_source_mixing": _MIX, "op9_license_scans": _LICENSES, "op12_vector_codes": _codes()}
