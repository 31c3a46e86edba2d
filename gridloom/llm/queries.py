"""The operators of this package as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, decontam, language, licenses, lm, packing, pii, ranking, simhash, tokencounts
from . import topk, toxicity, urls
from .common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op4_cost_balanced_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, folder, "documents")))


@register("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    model = language.train(docs, ~held_out)
    read = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.predict(read, model).select("doc_id", "held_out", "lang_pred", "score")


@register("op6_naive_bayes_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = crc_mod("doc_id", 4) == 2
    model = toxicity.train(docs, labels, ~held_out)
    read = docs.select("doc_id", held_out.alias("held_out"), "text")
    return toxicity.score(read, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@register("op8_url_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


@register("op5_simhash_pigeonring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@register("op3_pivot_topk", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, hash(text) AS th,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w
  FROM documents),
item_words AS (
  SELECT item_id,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w
  FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM doc_words),
i AS (
  SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS item_at
  FROM item_words WHERE len(w) >= 5),
agreeing AS (
  SELECT doc_id, item_id, n, pos - item_at AS start, item_at FROM d JOIN i USING (w)),
windows AS (
  SELECT doc_id, item_id, n, start,
    count(*) OVER (PARTITION BY doc_id, item_id, n, start ORDER BY item_at
      RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS matched
  FROM agreeing),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS k
  FROM windows WHERE matched >= CASE WHEN n < 13 THEN n ELSE 11 END)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(matched AS INTEGER) AS matched,
  CAST(n AS INTEGER) AS item_size
FROM ranked WHERE k = 1"""


@register("op2_spaced_seed_decontamination", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


@register("op10_license_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@register("op7_contextual_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.extract(docs, pii.trusted(pii.bootstrap(docs)))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


@register("op1_elias_fano_lm")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    model = lm.train(docs.where(~held_out))
    return lm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


OP11_SQL = r"""
WITH item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words
  FROM doc_terms WHERE len(terms) > 0),
held AS (
  SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM doc_terms),
counted AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM held
  WHERE term IN (SELECT term FROM item_terms) GROUP BY r, doc_id, n, term),
weighted AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole),
parts AS (
  SELECT r, doc_id, term,
    w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS part
  FROM counted JOIN weighted USING (term), whole),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM parts JOIN item_terms USING (term) GROUP BY item_id, r, doc_id HAVING sum(part) > 0),
ranked AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@register("op11_shared_ranking", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_sql(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    """Each round as three subqueries: nearest centroid, means, and centroids that stay."""
    parts = [
        f"""whole AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""long AS MATERIALIZED (
  SELECT r, unnest(v) AS x, unnest(range({size})) AS i FROM whole)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v
  FROM (SELECT sha256('3:' || vec_id) AS h, v FROM whole ORDER BY h NULLS LAST, v LIMIT {k}))""",
    ]
    for turn in range(rounds + 1):
        parts.append(
            f"""a{turn} AS MATERIALIZED (
  SELECT r, cluster, d FROM (
    SELECT r, cluster, d, row_number() OVER (PARTITION BY r ORDER BY d, cluster) AS best FROM (
      SELECT w.r, c.cluster, CAST(list_sum(list_transform(range(1, {size} + 1),
        lambda i: (w.v[i] - c.v[i]) * (w.v[i] - c.v[i]))) AS BIGINT) AS d
      FROM whole w, c{turn} c)) WHERE best = 1)"""
        )
        if turn < rounds:
            parts.append(
                f"""m{turn} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM a{turn} JOIN long USING (r) GROUP BY cluster, i) GROUP BY cluster)"""
            )
            parts.append(
                f"""c{turn + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN m{turn} m USING (cluster))"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN whole USING (r) JOIN c{rounds} c ON a.cluster = c.cluster"""
    )


@register("op12_drift_clusters", op12_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster(table(spark, folder, "embeddings"))


@register("op13_token_counts")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, folder, "documents"))
