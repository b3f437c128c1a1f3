"""Queries on the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions import text as fx
from textmill.operators import diversity, vectors
from textmill.plans.registry import query
from textmill.sources.tables import table

BOUNDS = {"dissimilar": (-1.0, 0.0), "medium": (0.0, 0.2), "similar": (0.2, 1.0)}
CENTROIDS = """
WITH c AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2),
v AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label),
s AS (SELECT x.label AS a, y.label AS b, list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(x.v, lambda p: p * p))) * sqrt(list_sum(list_transform(y.v, lambda p: p * p)))) AS sim FROM v x JOIN v y ON x.label <> y.label)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query("""
WITH u AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS x FROM embeddings),
s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM u GROUP BY 1, 2)
SELECT label, max(n) AS n, round(CASE WHEN max(n) < 2 THEN 0 ELSE 1 - (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) END, 6) AS diversity FROM s GROUP BY label""")
def semantic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), "embedding", ["label"]).withColumn("diversity", F.round("diversity", 6))


@query(CENTROIDS + " SELECT a, b, round(sim, 6) AS similarity FROM s WHERE a < b")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.label_similarity(table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("similarity", F.round("similarity", 6))


@query(CENTROIDS + f""", r AS (SELECT a, b, sim, CASE WHEN sim >= -1 AND sim < 0 THEN 'dissimilar' WHEN sim >= 0 AND sim < 0.2 THEN 'medium' WHEN sim >= 0.2 AND sim < 1 THEN 'similar' END AS stratum FROM s)
SELECT a, b, stratum, row_number() OVER (PARTITION BY a, stratum ORDER BY round(sim, 6) DESC, b) AS place FROM r WHERE stratum IS NOT NULL""")
def similarity_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = vectors.label_similarity(table(spark, sf_dir, "embeddings"), "embedding", "label")
    both = half.union(half.select(F.col("b"), F.col("a"), "similarity")).withColumn("stratum", vectors.stratum(F.col("similarity"), BOUNDS)).where("stratum is not null")
    return both.withColumn("place", F.row_number().over(W.partitionBy("a", "stratum").orderBy(F.desc(F.round("similarity", 6)), "b")).cast("long")).drop("similarity")


@query(CENTROIDS + """, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT median(n) AS m FROM n)
SELECT a AS rare, arg_max(b, (round(sim, 6), -b)) AS frequent, max(round(sim, 6)) AS similarity FROM s JOIN n x ON x.label = a JOIN n y ON y.label = b, k WHERE x.n < m AND y.n >= m GROUP BY a""")
def rare_to_frequent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    sizes = vecs.groupBy("label").agg(F.count("*").alias("n"))
    half = vectors.label_similarity(vecs, "embedding", "label")
    both = half.union(half.select(F.col("b"), F.col("a"), "similarity")).withColumn("similarity", F.round("similarity", 6))
    middle = sizes.agg(F.median("n").alias("m"))
    named = both.join(sizes.withColumnsRenamed({"label": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"label": "b", "n": "nb"}), "b").join(F.broadcast(middle))
    best = named.where("na < m and nb >= m").groupBy("a").agg(F.max_by("b", F.struct("similarity", -F.col("b"))).alias("frequent"), F.max("similarity").alias("similarity"))
    return best.withColumnRenamed("a", "rare")


@query(f"""
WITH s AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, round({DOT.format(a='q.embedding', b='p.embedding')}, 6) AS similarity FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s) WHERE rank <= 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    vecs = table(spark, sf_dir, "embeddings")
    found = vectors.nearest(vecs.where("vec_id % 100 = 0"), vecs, "vec_id", "embedding", 10)
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH p AS (SELECT x.label = y.label AS same, {DOT.format(a='x.embedding', b='y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE x.vec_id % 100 = 0)
SELECT same, count(*) AS pairs, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(exp(-2 * (2 - 2 * s))), 6) AS uniformity FROM p GROUP BY same""")
def pair_similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of the stated query set (ids divisible by 100) and all later vectors, by equality of labels."""
    vecs = table(spark, sf_dir, "embeddings")
    made = vectors.pair_statistics(vecs.where("vec_id % 100 = 0"), vecs, "vec_id", "embedding", "label")
    return made.select("same", "pairs", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "uniformity")])


APART = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


@query(f"""
WITH d AS (SELECT x.vec_id, x.label, y.label AS other, sum({APART}) AS total, count(*) FILTER (WHERE x.vec_id <> y.vec_id) AS n FROM embeddings x, embeddings y GROUP BY ALL),
s AS (SELECT vec_id, label, max(total / nullif(n, 0)) FILTER (WHERE label = other) AS own, min(total / n) FILTER (WHERE label <> other) AS far FROM d GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN own IS NULL THEN 0 ELSE (far - own) / greatest(own, far) END), 6) AS silhouette FROM s GROUP BY label""")
def cluster_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of the vectors of each label; the SQL compares all pairs."""
    made = vectors.silhouettes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return made.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query("""
WITH c AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), o AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM c GROUP BY 1, 2),
b AS (SELECT i, sum(s) AS s, sum(q) AS q, sum(n) AS n, sum(s * s / n) AS g, count(*) AS k FROM o GROUP BY i), t AS (SELECT sum(g - s * s / n) AS bt, sum(q - g) AS wi, max(n) AS n, max(k) AS k FROM b)
SELECT n::BIGINT AS n, k, round(bt, 4) AS between, round(wi, 4) AS within, round(bt / (k - 1) / (wi / (n - k)), 4) AS calinski_harabasz FROM t""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors.cluster_sums(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return made.select("n", "k", *[F.round(c, 4).alias(c) for c in ("between", "within", "calinski_harabasz")])
