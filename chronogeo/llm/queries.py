"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronogeo.llm import adaptive_ann, collocations, mixing, piece_codec, quality_knn, quality_rules, secret_links, signature_trees, simhash_pivots, substring_graph, token_alignment, token_counts, url_rules

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(_table(spark, sf_dir, "pages")).drop("pattern")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.coded(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.reported(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_graph.deduplicated(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.marked(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.linked(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(_table(spark, sf_dir, "documents"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_trees.joined(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_token_counts, op3_quality_classifier, op4_url_filters, op5_sentencepiece, op6_mixing, op7_secret_scans, op8_substring_dedup, op9_nearest_neighbours, op10_simhash, op11_token_alignment, op12_collocations, op13_ngram_jaccard, pipeline)
}

SQL_OP1 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, unnest(range(0, 5)) AS v(o) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lin.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lin ON lin.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS f FROM b GROUP BY source),
p AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(n * n) AS nn, sum(f * f / n) AS ffn FROM h),
r AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND n - nn / n - (k - 1) > 0 AND k > 1 THEN ((ffn - n * mean * mean) / (mean * (1 - mean)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0 END AS r FROM p),
s AS (SELECT mean, (1 - least(greatest(r, 1e-6), 0.999999)) / least(greatest(r, 1e-6), 0.999999) AS s FROM r),
v AS (SELECT h.source, (f + mean * s) / (n + s) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND v.rate <= 0.5) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

SQL_OP4 = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?:^|[.-])bets?\.') OR regexp_matches(host || path, '^[^/]*(?:^|[.-])casino[.-]') OR regexp_matches(host || path, '(?:^|[./-])cheap-pills(?:[./-]|$)')
    OR regexp_matches(host || path, '^[^/]*(?:^|[.-])xxx[.-]') OR regexp_matches(host || path, '/wp-login\.php$') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""

SQL_OP6 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(3 * source_size) OVER q - 3 * source_size AS caps, sum(weight) OVER () - (sum(weight) OVER q - weight) AS weights, sum(source_size) OVER () AS total
  FROM s WINDOW q AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST)),
l AS (SELECT coalesce((SELECT (total - caps) / CAST(weights AS DOUBLE) FROM o WHERE (total - caps) / CAST(weights AS DOUBLE) <= 3 * source_size / CAST(weight AS DOUBLE) ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1), 0) AS level),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target FROM s, l),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), hash, doc_id, size) AS k FROM d),
c AS (SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, CAST('0x' || substr(md5('mix|offset|' || coalesce(t.source, '-')), 1, 5) AS BIGINT) / 1048576.0 AS u
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) AS BIGINT) * size AS taken FROM c
"""


def _sql_op7() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for kind, (pattern, group, least, most) in secret_links.KINDS.items():
        size = f"length(regexp_extract_all(t, {quoted(pattern)}, {group})[i])"
        parts.append(
            f"SELECT doc_id, {secret_links.ORDER[kind]} AS kind, s AS b, e FROM (SELECT doc_id, {size} AS size, "
            f"CAST(sum(length(string_split_regex(t, {quoted(pattern)})[i])) OVER q + sum(length(regexp_extract_all(t, {quoted(pattern)})[i])) OVER q - length(regexp_extract_all(t, {quoted(pattern)})[i]) AS INT) AS s, "
            f"CAST(sum(length(string_split_regex(t, {quoted(pattern)})[i])) OVER q + sum(length(regexp_extract_all(t, {quoted(pattern)})[i])) OVER q AS INT) AS e "
            f"FROM d, unnest(range(1, len(regexp_extract_all(t, {quoted(pattern)})) + 1)) AS u(i) WINDOW q AS (PARTITION BY doc_id ORDER BY i)) WHERE size >= {least}" + (f" AND size <= {most}" if most else "")
        )
    names = "['" + "','".join(secret_links.KINDS) + "']"
    scope = secret_links.SCOPE
    text = f"string_agg({names}[kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(parts)}),
n AS (SELECT w.doc_id, w.kind, w.b, w.e, bool_or(p.kind IN (1, 4)) AS ident, bool_or(p.kind IN (0, 2, 3)) AS secret
  FROM a w JOIN a p ON w.doc_id = p.doc_id AND w.kind >= 3 AND p.kind <> 5 AND p.b <= w.e + {scope} AND p.e >= w.b - {scope} AND NOT (p.b = w.b AND p.e = w.e AND p.kind = w.kind) GROUP BY ALL),
k AS (SELECT doc_id, kind, b, e FROM n WHERE (kind = 3 AND ident) OR (kind = 4 AND secret) OR (kind = 5 AND ident AND secret)),
base AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a0, count(*) FILTER (WHERE kind = 1) AS a1, count(*) FILTER (WHERE kind = 2) AS a2, {text} AS x FROM a WHERE kind < 3 GROUP BY doc_id),
whole AS (SELECT doc_id, {text} AS x FROM (SELECT * FROM a WHERE kind < 3 UNION ALL SELECT * FROM k) GROUP BY doc_id)
SELECT d.doc_id, coalesce(a0, 0) AS n_assign, coalesce(a1, 0) AS n_access, coalesce(a2, 0) AS n_hex, sha256(coalesce(base.x, '')) AS base_sha256, coalesce(whole.x, '') AS spans
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN whole ON whole.doc_id = d.doc_id
"""


SQL_OP8 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM rep, unnest(range(0, 20)) AS v(o)),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t, count(*) AS n FROM (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(i)) p
  LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_OP12 = rf"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, ws[i:i+k-1] AS ph FROM p, unnest(range(1, 5)) AS a(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
f AS (SELECT lang, ph, len(ph) AS k, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= {collocations.MIN_COUNT}),
c AS (SELECT * FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.ph, c.f AS a, i, l.f AS l, r.f AS r, (CAST({collocations.SCALE} AS HUGEINT) * c.f) // (l.f + r.f) AS score
  FROM c, unnest(range(1, c.k)) AS u(i) JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:i] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[i+1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, i) = 1),
sub AS (SELECT lang, ph[i:i+m-1] AS ph, max(f) AS most FROM c, unnest(range(2, c.k)) AS v(m), unnest(range(1, c.k - m + 2)) AS u(i) GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.ph, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.ph = best.ph WHERE most IS NULL OR 100 * most < {collocations.COVERED_PERCENT} * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN t ON t.lang = kept.lang
QUALIFY rank <= {collocations.TOP}
"""

SQL_OP13 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {signature_trees.PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(to_id) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": SQL_OP1,
    "op4_url_filters": SQL_OP4,
    "op6_mixing": SQL_OP6,
    "op7_secret_scans": _sql_op7(),
    "op8_substring_dedup": SQL_OP8,
    "op12_collocations": SQL_OP12,
    "op13_ngram_jaccard": SQL_OP13,
}
