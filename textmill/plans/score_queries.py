"""Queries on scores: calibration, categories, ratios, losses, statistics of detectors and of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import scores
from textmill.plans.registry import query
from textmill.sources.tables import table

PROBABILITY = "p AS (SELECT event_id, user_id, event_type, (event_id * 37 % 1001) / 1000.0::DOUBLE AS p FROM events)"


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a made-up probability."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", "value", (F.col("event_id") * 37 % 1001 / 1000.0).cast("double").alias("p"))


CALIBRATED = f"""WITH {PROBABILITY},
r AS (SELECT *, CASE WHEN p < 0.4 THEN 1 - p WHEN p < 0.45 THEN 0.6::DOUBLE - p ELSE greatest(0, 0.4::DOUBLE - p * 0.5) END AS a, CASE WHEN p > 0.6 THEN p WHEN p > 0.55 THEN p - 0.1::DOUBLE ELSE greatest(0, p * 0.5 - 0.1::DOUBLE) END AS c FROM p),
k AS (SELECT *, greatest(0, least(1, a)) AS neg, greatest(0, least(1, 1 - (a + c))) AS neu, greatest(0, least(1, c)) AS pos FROM r),
c AS (SELECT event_id, event_type, p, neg / (neg + neu + pos) AS neg, neu / (neg + neu + pos) AS neu, pos / (neg + neu + pos) AS pos FROM k)"""


@query(CALIBRATED + " SELECT event_id, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos, CASE WHEN pos > greatest(neg, neu) THEN 'Positive' WHEN neg > greatest(pos, neu) THEN 'Negative' ELSE 'Neutral' END AS category FROM c")
def sentiment_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = probabilities(spark, sf_dir).select("event_id", scores.calibrated(F.col("p")).alias("s"))
    return made.select("event_id", *[F.round(f"s.{k}", 6).alias(k) for k in ("neg", "neu", "pos")], scores.category(F.col("s")).alias("category"))


@query(CALIBRATED + " SELECT event_type, count(*) FILTER (WHERE neg > 0.5) AS mostly_neg, count(*) FILTER (WHERE neu > 0.5) AS mostly_neu, count(*) FILTER (WHERE pos > 0.5) AS mostly_pos FROM c GROUP BY 1")
def dominance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = probabilities(spark, sf_dir).select("event_type", scores.calibrated(F.col("p")).alias("s"))
    return made.groupBy("event_type").agg(*[F.count_if(F.col(f"s.{k}") > 0.5).alias(f"mostly_{k}") for k in ("neg", "neu", "pos")])


@query(
    r"WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, greatest(len(w), 1), 512)) AS i, w FROM t), s AS (SELECT doc_id, w[i + 1 : i + 512] AS c FROM c),"
    r" q AS (SELECT doc_id, len(list_filter(c, lambda x: length(x) > 3)) / greatest(len(c), 1)::DOUBLE AS a, len(list_filter(c, lambda x: regexp_matches(x, '^[A-Z]'))) / greatest(len(c), 1)::DOUBLE AS b FROM s) SELECT doc_id, count(*) AS chunks, round(avg((0.4 * a + 0.6 * b) / 1.0), 6) AS score FROM q GROUP BY 1"
)
def chunk_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 words, each with two shares in place of model probabilities, weighted 0.4 and 0.6, and their mean over the chunks."""
    word = r"[^\x20\x09-\x0D]+"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(word), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w"), F.lit(1)) - 1, F.lit(512))
    chunks = docs.select("doc_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, 512))).alias("c"))
    share = lambda test: F.size(F.filter("c", test)) / F.greatest(F.size("c"), F.lit(1))
    both = [(share(lambda x: F.length(x) > 3), 0.4), (share(lambda x: x.rlike("^[A-Z]")), 0.6)]
    return chunks.select("doc_id", scores.ensemble(both).alias("s")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.round(F.avg("s"), 6).alias("score"))


@query("""WITH f AS (SELECT user_id, arg_min(value, event_id) AS own, min(event_id) AS first FROM events GROUP BY 1), q AS (SELECT e.user_id, avg(value) AS mean, stddev_pop(value) AS std FROM events e JOIN f ON f.user_id = e.user_id AND e.event_id <> first GROUP BY 1)
SELECT user_id, round(ln(own + 1e-10) - ln(mean + 1e-10), 6) AS log_ratio, round(CASE WHEN std > 0 THEN (own - mean) / std ELSE own - mean END, 6) AS z FROM f JOIN q USING (user_id)""")
def logratio_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a user as a text's likelihood, the others as those of its perturbations."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    first = events.groupBy("user_id").agg(F.min_by("value", "event_id").alias("own"), F.min("event_id").alias("first"))
    rest = events.join(first, "user_id").where("event_id <> first").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    own, mean, std = F.col("own"), F.col("mean"), F.col("std")
    made = first.join(rest, "user_id")
    return made.select("user_id", F.round(scores.log_ratio(own, mean), 6).alias("log_ratio"), F.round(scores.z_score(own, mean, std), 6).alias("z"))


@query("SELECT l.toxic, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars) - (SELECT avg(n_chars) FROM documents JOIN labels USING (doc_id) WHERE toxic = 0), 6) AS beyond FROM documents JOIN labels l USING (doc_id) GROUP BY 1")
def detector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a score by class, and the difference in means from class 0."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("toxic", "n_chars")
    made = rows.groupBy("toxic").agg(
        F.count("*").alias("n"), F.avg("n_chars").alias("m"), F.round(F.stddev_samp("n_chars"), 6).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")
    )
    base = made.where("toxic = 0").select(F.col("m").alias("b"))
    return made.join(F.broadcast(base), how="left").select("toxic", "n", F.round("m", 6).alias("mean"), "std", "least", "most", F.round(F.col("m") - F.col("b"), 6).alias("beyond"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def population_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("""WITH e AS (SELECT user_id, value / 10 AS v, 1 + event_id % 5 AS q FROM events), t AS (SELECT user_id, max(v) AS top, sum(q) AS total FROM e GROUP BY 1)
SELECT user_id, round(ln(sum(exp(v - top))) + any_value(top) - sum(q / total * v), 6) AS loss FROM e JOIN t USING (user_id) GROUP BY 1""")
def soft_label_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 10).alias("v"), (1 + F.col("event_id") % 5).cast("double").alias("q"))
    return scores.soft_cross_entropy(events, "user_id", "v", "q").withColumn("loss", F.round("loss", 6))


@query("""WITH l AS (SELECT event_type AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events), c AS (SELECT before, after, count(*) AS n FROM l WHERE after IS NOT NULL GROUP BY 1, 2)
SELECT before, after, n, round(100 * n / sum(n) OVER (), 6) AS percent FROM c""")
def category_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.transitions(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type").withColumn("percent", F.round("percent", 6))


@query("SELECT doc_id, round(quality * (1 + r), 6) AS sample_weight, round(quality * (1 + r / 2), 6) AS loss_weight FROM (SELECT doc_id, quality, least(n_chars / 10000.0::DOUBLE, 1) AS r FROM labels JOIN documents USING (doc_id))")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    made = rows.select("doc_id", *scores.sample_weight(F.col("quality").cast("double"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0))))
    return made.select("doc_id", F.round("sample_weight", 6).alias("sample_weight"), F.round("loss_weight", 6).alias("loss_weight"))


@query("WITH m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'error') AS b, avg(value) FILTER (WHERE event_type = 'purchase') AS c, avg(value) FILTER (WHERE event_type = 'view') AS d FROM events GROUP BY 1) SELECT user_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)) / 4, 6) AS overall FROM m")
def overall_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of four entities' scores, 0 where one is missing."""
    kinds = ("click", "error", "purchase", "view")
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])
    return means.select("user_id", F.round(sum((F.coalesce(k, F.lit(0.0)) for k in kinds), F.lit(0.0)) / 4, 6).alias("overall"))


@query("WITH u AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT k, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 5")
def frequent_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    return both.groupBy("k").agg(F.count("*").alias("n")).where("n >= 5")


@query("SELECT user_id, arg_min(value, event_id) FILTER (WHERE event_type = 'click' AND value > 20) AS value FROM events GROUP BY 1")
def first_valid_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = (F.col("event_type") == "click") & (F.col("value") > 20)
    return scores.first_valid(table(spark, sf_dir, "events"), "user_id", "event_id", valid, "value")


@query("SELECT user_id, last(value ORDER BY event_id) AS last_value, max(value) AS best, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS best_at FROM events GROUP BY 1")
def last_and_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"), F.max("value").alias("best"), best.alias("best_at"))

