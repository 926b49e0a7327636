"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

#: Words of a text, A-Z lower-cased only.
WORDS = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{1}'), lambda x: x <> '')"
NOT_SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP8 = f"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {WORDS.format('text', NOT_WORD)} AS w FROM benchmark
), numbered AS (SELECT *, row_number() OVER () AS text_no FROM items
), placed AS (
  SELECT item, text_no, len(w) AS n, 1 AS place, array_to_string(w, ' ') AS win FROM numbered WHERE len(w) BETWEEN 1 AND 12
  UNION ALL
  SELECT item, text_no, 13, i, array_to_string(w[i:i + 12], ' ') FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM numbered WHERE len(w) >= 13)
), windows AS (SELECT DISTINCT item, n, win FROM placed
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, {WORDS.format('text', NOT_WORD)} AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows), spots AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT row, i, s.n, item FROM spots s JOIN windows v ON s.win = v.win AND s.n = v.n
), hit AS (
  SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM found) GROUP BY row
), chains AS (  -- windows of one item in a row: a longer match
  SELECT row, min(i) AS spot, max(i) - min(i) + max(n) AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY row, item, text_no, n, i - place ORDER BY i) AS chain, i - place AS shift
    FROM (SELECT row, i, s.n, item, text_no, place FROM spots s JOIN placed v ON s.win = v.win AND s.n = v.n)
  ) GROUP BY row, item, text_no, n, shift, chain
), far AS (
  SELECT row, -best.l AS longest, best.s - 1 AS longest_at FROM (SELECT row, min(struct_pack(l := -length, s := spot)) AS best FROM chains GROUP BY row)
), named AS (
  SELECT row, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row) LEFT JOIN far USING (row)
"""

OP6 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(len({WORDS.format('text', NOT_SPACE)}) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), b AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) AS budget, sum(weight) AS all_weight FROM s
), levels AS (  -- the level at which the k sources of least size for their weight are full
  SELECT (budget - coalesce(sum(2 * source_size) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level, 2.0 * source_size / weight AS own
  FROM s, b WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (SELECT coalesce(arg_min(level, own) FILTER (WHERE own >= level), max(own)) AS level FROM levels
), t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM s, lev
), f AS (
  SELECT row, doc_id, size, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT size, unnest([words / target, (source_size + words) / target]) AS fin FROM f WHERE target > 0 AND size > 0
), r AS (SELECT fin, sum(sum(size)) OVER (ORDER BY fin) AS total FROM i GROUP BY fin
), cut AS (SELECT coalesce(max(fin), 0) AS fin FROM r, b WHERE total <= budget)
SELECT doc_id, size, source_size, target,
  size * CASE WHEN target > 0 THEN CAST(words / target <= fin AS BIGINT) + CAST((source_size + words) / target <= fin AS BIGINT) ELSE 0 END AS taken
FROM f, cut
"""


def _ranks(seed: str, source: str, target: str, name: str, iterations: int = 15) -> str:
    """CTEs of one personalised PageRank, unrolled."""
    steps = [f"""{name}0 AS (SELECT host, {seed} / sum({seed}) OVER () AS rank FROM shares WHERE {seed} >= 0.5)""",
             f"""{name}w AS (SELECT {source} AS host, {target} AS too, n / sum(n) OVER (PARTITION BY {source}) AS share FROM links)"""]
    for i in range(iterations):
        steps.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (
          SELECT w.too AS host, 0.85 * r.rank * w.share AS rank FROM {name}{i} r JOIN {name}w w ON r.host = w.host
          UNION ALL SELECT host, 0.15 * rank FROM {name}0) GROUP BY host)""")
    return ", ".join(steps)


OP5 = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (
  SELECT row_number() OVER () AS row, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT row, page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a
), hit AS (
  SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row
), links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/"''?#\\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM p WHERE host <> '') WHERE src <> dst GROUP BY ALL
), shares AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS allow, avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS block
  FROM p LEFT JOIN hit USING (row) WHERE host <> '' GROUP BY host
), {_ranks('allow', 'src', 'dst', 't')}, {_ranks('block', 'dst', 'src', 'b')},
bad AS (SELECT b15.host FROM b15 LEFT JOIN t15 USING (host) WHERE b15.rank > coalesce(t15.rank, 0))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit USING (row)
"""


OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS row, CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS a, a.id AS anchor_id, b.row AS b, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.id % 50 = 0 AND a.row <> b.row
), positive AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5
), mined AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST, n.b) AS rank
  FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 3
"""


def oracle() -> dict[str, str]:
    return {"op13_lemp_hard_negatives": OP13, "op5_link_graph_urls": OP5, "op6_weighted_fair_mix": OP6, "op8_suffix_array_decontamination": OP8}
