"""DuckDB SQL for the rows of the queries that SQL can express, written from the contracts."""

from __future__ import annotations

from freshet.llm.license_scan import GAPS, RULES, SENTENCES, table_of
from freshet.llm.url_filter import DEVIATIONS, LIMIT, TWO_LABEL_SUFFIXES
from freshet.llm.url_filter import RULES as URL_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
WORD = r"'[^\x20\x09-\x0D]+'"

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

DECONTAMINATION = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {ALNUM}) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(w[s : s + 9]) AS n, array_to_string(w[s : s + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {ALNUM}) AS w FROM documents
), places AS (
  SELECT doc_id, w, n, s FROM docs, (SELECT DISTINCT n FROM windows) l, unnest(range(1, len(w) - n + 2)) t(s)
), hits AS (
  SELECT p.doc_id, item_id, s, p.n FROM places p
  JOIN windows x ON x.n = p.n AND array_to_string(w[s : s + p.n - 1], ' ') = x.words
), totals AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS spot FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN totals USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _licenses() -> str:
    known = table_of(SENTENCES)
    names = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in known.items()) + "}"
    steps, left = [], "coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '')"
    for k, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"<{name}>" for name in sequence)
        steps.append(f"l{k + 1} AS (SELECT *, replace({left}, {_quoted(pattern)}, '|') AS r{k + 1} FROM {f'l{k}' if k else 'l0'})")
        left = f"r{k + 1}"
    said = ", ".join(f"CASE WHEN r{k} <> r{k + 1} THEN {_quoted(name)} END" for k, (name, _) in enumerate(RULES))
    order = ", ".join(_quoted(x) for x in dict.fromkeys(name for name, _ in RULES))
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
    string_split_regex({LOWER.format("coalesce(text, '')")}, '[.!?]+[ \\t\\r\\n]+|[.!?]+\\z|\\n+'),
    lambda s: trim(regexp_replace(s, '{GAPS}', ' ', 'g'))), lambda s: s <> '') AS sentences
  FROM documents
), l0 AS (
  SELECT doc_id, len(sentences) AS n_sentences, list_filter(list_transform(sentences, lambda s: {names}[s]), lambda i: i IS NOT NULL) AS ids,
    coalesce(array_to_string(list_transform(list_filter(list_transform(sentences, lambda s: {names}[s]), lambda i: i IS NOT NULL), lambda i: '<' || i || '>'), ''), '') AS r0
  FROM cut
), {", ".join(steps).replace("coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '')", "r0")}
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known,
  CAST(length(r{len(RULES)}) - length(replace(r{len(RULES)}, '<', '')) AS BIGINT) AS n_unmatched,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter([{order}], lambda n: list_contains([{said}], n)), ','), '') AS licenses
FROM l{len(RULES)}
"""


MIX = f"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS room_words FROM src
), ordered AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(room_words) OVER o, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS rate
  FROM weighed WINDOW o AS (ORDER BY room_words / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), one AS (
  SELECT arg_min(rate, room_words / CAST(weight AS DOUBLE)) AS rate FROM ordered WHERE room_words / CAST(weight AS DOUBLE) > rate
), targets AS (
  SELECT source, source_size, CASE WHEN room_words / CAST(weight AS DOUBLE) > one.rate THEN weight * one.rate ELSE CAST(room_words AS DOUBLE) END AS target
  FROM ordered, one
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM targets
), ranked AS (
  SELECT doc_id, size, source_size, target, d.source, floor(share) AS whole, share - floor(share) AS p,
    target - floor(share) * source_size AS wanted,
    (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN shares ON d.source IS NOT DISTINCT FROM shares.source
), running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND wanted > 0 AND (upto <= wanted OR upto - wanted <= wanted - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORD}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[s] || ' ' || w[s + 1] AS g FROM words, unnest(range(1, len(w))) t(s)
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, met) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.met
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _urls() -> str:
    suffixes = ", ".join(map(_quoted, TWO_LABEL_SUFFIXES))
    cases = ""
    for rule in sorted(URL_RULES, key=lambda r: (-len(r.pattern), r.verdict != "block", r.pattern)):
        cases += f" WHEN (host = {_quoted(rule.host)} OR ends_with(host, {_quoted('.' + rule.host)})) AND starts_with(path, {_quoted(rule.path)}) THEN {_quoted(rule.pattern)}"
    verdicts = " ".join(f"WHEN {_quoted(r.pattern)} THEN {_quoted(r.verdict)}" for r in URL_RULES)

    def strength(level: str) -> str:
        return f"""(SELECT CASE WHEN k > 0 AND k < n THEN 1 / least(greatest(CASE WHEN room > 0 THEN round(spread / room, 6) ELSE 0.5 END, 0.001), 0.999) - 1 ELSE 1 END FROM (
  SELECT n, k, (kk - k * (k / n)) / nullif((k / n) * (1 - k / n), 0) - (g - 1) AS spread, n - nn / n - (g - 1) AS room FROM (
    SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k, count(*) FILTER (n > 0) AS g, sum(CASE WHEN n > 0 THEN bad * bad / CAST(n AS DOUBLE) ELSE 0 END) AS kk, sum(CAST(n * n AS DOUBLE)) AS nn FROM {level})))"""

    return rf"""
WITH parts AS (
  SELECT page_id, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), outcomes AS (
  SELECT doc_id AS page_id, bool_or(bad) AS bad FROM (
    SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN true WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN false END AS bad FROM labels
  ) WHERE bad IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT *, list_reverse(string_split(host, '.')) AS l FROM (
    SELECT host, count(bad) AS n, count(*) FILTER (bad) AS bad FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host)
), named AS (
  SELECT host, n, bad, k AS suffix_labels, array_to_string(list_reverse(l[1 : k]), '.') AS suffix, array_to_string(list_reverse(l[1 : k + 1]), '.') AS domain
  FROM (SELECT *, CASE WHEN l[2] || '.' || l[1] IN ({suffixes}) THEN 2 ELSE 1 END AS k FROM hosts)
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), strengths AS (
  SELECT {strength("named")} AS h, {strength("domains")} AS d, {strength("suffixes")} AS s, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) FROM suffixes) AS m
), suffix_share AS (
  SELECT suffix, (bad + s * m) / (n + s) AS share FROM suffixes, strengths
), domain_share AS (
  SELECT domain, (bad + d * share) / (n + d) AS share FROM domains JOIN suffix_share USING (suffix), strengths
), beta AS (
  SELECT host, n, bad, bad + h * share AS a, n - bad + h * (1 - share) AS b FROM named JOIN domain_share USING (domain), strengths
), judged AS (
  SELECT host, n, bad, a / (a + b) - {DEVIATIONS} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {LIMIT} AS blocked FROM beta
), ruled AS (
  SELECT *, CASE {cases} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN blocked THEN 'block' ELSE 'allow' END END AS verdict,
  CAST(n AS BIGINT) AS host_outcomes, CAST(bad AS BIGINT) AS host_bad
FROM ruled JOIN judged USING (host)
"""


SQL: dict[str, str] = {
    "op2_topk_search": TOPK,
    "op3_decontamination": DECONTAMINATION,
    "op4_license_scan": _licenses(),
    "op8_mix_sources": MIX,
    "op9_near_dedup": NEAR_DEDUP,
    "op10_url_filter": _urls(),
}
