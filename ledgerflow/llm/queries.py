"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode, packed_length

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    return both.select("doc_id", packed_length().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]

OP6_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM urls)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', '0', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 6)
              AS BIGINT) AS cell
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 2 * CAST(sum(size) AS DOUBLE) AS cap,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM docs GROUP BY source),
nth AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM nth),
lev AS (SELECT level FROM levels WHERE cap >= weight * level ORDER BY k LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN cap < weight * level THEN cap ELSE weight * level END AS target
  FROM sources, lev),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest
  FROM goals),
cells AS (SELECT source, cell, sum(size) AS n FROM docs GROUP BY source, cell),
sums AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY cell) AS upto FROM cells),
once AS (
  SELECT s.source, max(s.cell) AS last FROM sums s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
  WHERE rest > 0 AND (upto <= rest OR (upto - n < rest AND upto - rest < rest - upto + n)) GROUP BY s.source)
SELECT d.doc_id, d.size, CAST(p.source_size AS BIGINT) AS source_size, p.target,
       CAST(p.whole AS BIGINT) + CASE WHEN d.cell <= o.last THEN 1 ELSE 0 END AS copies,
       d.size * (CAST(p.whole AS BIGINT) + CASE WHEN d.cell <= o.last THEN 1 ELSE 0 END) AS taken
FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN once o ON d.source IS NOT DISTINCT FROM o.source
"""


@query("op7_source_mix", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0]


OP8_SQL = """
WITH sums AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                     sha1(coalesce(html, '')) AS sha FROM pages),
typed AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM sums)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM typed
"""


@query("op8_warc_zip", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("payload")


@query("op9_simhash_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge, learn

    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))


@query("op2_nearest_vectors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import joined, learn_from_text, of_kind, scan

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, learn_from_text(docs))
    return found.select("doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(joined(of_kind("assign", "access", "hex")), 256).alias("base_sha256"),
                        joined("spans").alias("spans"), F.size(of_kind("random")).cast("long").alias("n_random"))


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import removed_lines, without_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = without_lines(docs, removed_lines(docs), told="lines")
    return clean.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.kept_in", "text")


def op11_sql(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """Every round as its own common table expressions."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
         AS BIGINT), k := k)) AS best FROM kept, c{r} GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  WITH sums AS (SELECT best.k AS k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY 1, 2),
  means AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums GROUP BY k)
  SELECT c{r}.k, coalesce(means.c, c{r}.c) AS c FROM c{r} LEFT JOIN means USING (k))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.k = c{rounds}.k"""


@query("op11_centroids", op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))[0]


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query("op12_exact_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    return dedup(spark, f"{sf_dir}/documents.parquet").withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


OP13_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents),
split AS MATERIALIZED (SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, list_slice(w, i, i + size - 1) AS p
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split) s, range(1, 5) t(size) WHERE i + size - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, p, len(p) AS size, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
cand AS (SELECT * FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cand c JOIN range(1, 4) t(k) ON k < c.size
  JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.size)),
scored AS (
  SELECT lang, p, a, best.l AS l, best.r AS r, best.score AS score
  FROM (SELECT lang, p, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS best FROM cuts GROUP BY lang, p, a)),
within AS (
  SELECT c.lang, list_slice(c.p, i, i + m - 1) AS p, max(c.a) AS around
  FROM cand c, range(2, 4) t(m), range(1, 4) u(i) WHERE m < c.size AND i + m - 1 <= c.size GROUP BY 1, 2),
kept AS (
  SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM scored s LEFT JOIN within w ON w.lang = s.lang AND w.p = s.p
  WHERE w.around IS NULL OR 100::HUGEINT * w.around < 80::HUGEINT * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_mining", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import phrases

    return phrases(table(spark, sf_dir, "documents"))
