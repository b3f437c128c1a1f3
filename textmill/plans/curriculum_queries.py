"""Queries on splits, strata, curricula, difficulty and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import evaluate, sampling
from textmill.operators.lineage import cut
from textmill.operators.rollup import overall_rank, running_totals
from textmill.plans.registry import query
from textmill.sources.tables import hash_sample, table, union_all


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")


DRAW = "md5(concat_ws(':', doc_id, 42))"
SIZES = "WITH d AS (SELECT doc_id, source, lang, n_chars FROM documents), n AS (SELECT count(*) AS n FROM documents)"


@query("SELECT doc_id, CASE WHEN doc_id % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sampling.bucket_split(F.col("doc_id"), 20).alias("split"))


@query("WITH c AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM documents) SELECT doc_id, len(list_filter(list_distinct([a, b, c]), lambda x: n_chars > x)) AS bin FROM documents, c")
def quality_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sampling.quantile_bins(documents(spark, sf_dir), "n_chars")
    return made.select("doc_id", F.col("bin").cast("long").alias("bin"))


@query(
    SIZES + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM d) SELECT phase, doc_id FROM r, n, (VALUES ('first', 0.3::DOUBLE), ('second', 0.7::DOUBLE), ('third', 1.0::DOUBLE)) v(phase, share) WHERE place <= floor(share * n)"
)
def curriculum_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.phases(documents(spark, sf_dir), [F.desc("n_chars"), F.col("doc_id")], "doc_id", {"first": 0.3, "second": 0.7, "third": 1.0})


@query(SIZES + ", t AS (SELECT quantile_cont(n_chars, 0.3) AS t FROM d) SELECT doc_id, n_chars FROM d, t WHERE n_chars <= t")
def curriculum_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stage(documents(spark, sf_dir), "n_chars", "doc_id", 0.3).select("doc_id", "n_chars")


@query(SIZES + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM d) SELECT doc_id FROM r, n WHERE place <= greatest(1000, least(floor(n * 0.4), n))")
def curriculum_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.easiest(documents(spark, sf_dir), "n_chars", "doc_id", 0.4).select("doc_id")


EXAMPLES = r"""
WITH f AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY 1), m AS (SELECT max(n) AS top FROM f),
e AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(text, '[0-9]+')) AS spans, 1 - f.n / top AS rarity FROM documents d JOIN f ON f.source = d.source, m)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled examples: words, runs of figures as spans, and how rare the source is."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    rarity = sizes.join(F.broadcast(sizes.agg(F.max("n").alias("top")))).select("source", (1 - F.col("n") / F.col("top")).alias("rarity"))
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return docs.select("doc_id", "source", count(r"[^\x20\x09-\x0D]+").alias("words"), count("[0-9]+").alias("spans")).join(rarity, "source")


@query(EXAMPLES + " SELECT doc_id, round(0.2 * least(words / 256, 1) + 0.3 * least(spans / 10, 1) + 0.3 * CASE WHEN spans = 0 THEN 0 ELSE rarity END + 0.2 * least(10 * spans / greatest(words, 1), 1), 6) AS difficulty FROM e")
def difficulty_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rarity = F.when(F.col("spans") == 0, F.lit(0.0)).otherwise(F.col("rarity"))
    return examples(spark, sf_dir).select("doc_id", F.round(sampling.difficulty(F.col("words"), F.col("spans"), rarity), 6).alias("difficulty"))


@query(EXAMPLES + ", p AS (SELECT quantile_cont(words, 0.95) AS w, quantile_cont(spans, 0.95) AS s FROM e) SELECT doc_id, round(0.6 * least(coalesce(words / nullif(w, 0), 0), 1) + 0.4 * least(coalesce(spans / nullif(s, 0), 0), 1), 6) AS difficulty FROM e, p")
def difficulty_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the quantiles read their rows several times, so texts are counted and sources joined once before
    made = sampling.scaled_difficulty(cut(examples(spark, sf_dir).select("doc_id", "words", "spans")), {"words": 0.6, "spans": 0.4})
    return made.select("doc_id", F.round("difficulty", 6).alias("difficulty"))


@query(SIZES + ", p AS (SELECT unnest([10, 25, 50, 75, 90, 100]) AS percent, unnest(quantile_cont(n_chars, [0.1, 0.25, 0.5, 0.75, 0.9, 1.0])) AS threshold FROM d) SELECT percent, round(threshold, 6) AS threshold, count(*) AS n FROM d JOIN p ON n_chars <= threshold GROUP BY 1, 2")
def percentile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.percentile_counts(documents(spark, sf_dir), "n_chars").withColumn("threshold", F.round("threshold", 6))


@query(SIZES + " SELECT doc_id, round((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / (n - 1), 9) AS normalised FROM d, n")
def rank_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rank_normalised(documents(spark, sf_dir), "n_chars", "doc_id").select("doc_id", F.round("normalised", 9).alias("normalised"))


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS step FROM documents), x AS (SELECT *, step / 100.0 AS x FROM s), k AS (SELECT unnest(['linear', 'cosine', 'exponential']) AS kind)
SELECT kind, doc_id, step, round(CASE WHEN step >= 100 THEN 0.9 ELSE greatest(least(CASE kind WHEN 'linear' THEN 0.3 + 0.6 * x WHEN 'cosine' THEN 0.3 + 0.6 * (1 - cos(x * pi())) / 2 ELSE 0.3 * pow(3, x) END, 0.9), 0.3) END, 9) AS threshold FROM x, k""")
def threshold_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that holds when each document is reached, one document a step."""
    steps = overall_rank(documents(spark, sf_dir).select("doc_id"), [F.col("doc_id")], "step").withColumn("step", F.col("step") - 1)
    kinds = ("linear", "cosine", "exponential")
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.round(sampling.schedule(F.col("step"), 100, 0.3, 0.9, k), 9).alias("threshold")) for k in kinds])
    return steps.select("doc_id", "step", F.inline(every)).select("kind", "doc_id", "step", "threshold")


@query("""WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS seen, sum(n_chars) OVER () AS total, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, seen, floor((0.4 + 0.6 * least(seen / total::DOUBLE / 0.5, 1)) * n)::BIGINT AS size, floor((0.4 + 0.6 * least((seen - n_chars) / total::DOUBLE / 0.5, 1)) * n)::BIGINT AS before FROM r)
SELECT doc_id, seen::BIGINT AS seen, size FROM s WHERE size > before""")
def curriculum_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after which the active part of the curriculum grows: from 0.4 of the documents to all, over the first half of the characters."""
    docs = documents(spark, sf_dir).select("doc_id", "n_chars")
    totals = docs.agg(F.sum("n_chars").alias("total"), F.count("*").alias("n"))
    placed = running_totals(docs, [F.col("doc_id")], ["n_chars"]).join(F.broadcast(totals))
    size = lambda seen: F.floor((0.4 + 0.6 * F.least(seen / F.col("total") / 0.5, F.lit(1.0))) * F.col("n"))
    seen = F.col("run_n_chars")
    return placed.select("doc_id", seen.alias("seen"), size(seen).alias("size"), size(seen - F.col("n_chars")).alias("before")).where("size > before").drop("before")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.95) THEN 'train' ELSE 'test' END AS split FROM documents")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 95 of 100 documents train, the last five test."""
    return sampling.positional_split(documents(spark, sf_dir).select("doc_id"), [F.col("doc_id")])


@query("""
WITH s AS (SELECT c_custkey AS step FROM customer), d AS (SELECT source, count(*) AS examples, list_sort(list(DISTINCT lang)) AS types FROM documents GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS place, count(*) OVER () AS n FROM d), c AS (SELECT 'combined' AS source, count(*) AS examples, list_sort(list(DISTINCT lang)) AS types FROM documents WHERE source <> 'forum'),
r AS (SELECT 'cycling' AS strategy, step, source, examples, types FROM s JOIN p ON step % n = place
 UNION ALL SELECT 'random', step, source, examples, types FROM s JOIN p ON ('0x' || substr(md5(step || ':42'), 1, 8))::BIGINT % n = place
 UNION ALL SELECT 'all', step, source, examples, types FROM s, d WHERE step <= 20 UNION ALL SELECT 'combined', step, source, examples, types FROM s, c WHERE step <= 20)
SELECT strategy, step, source AS dataset, examples, array_to_string(types, ',') AS types FROM r""")
def evaluation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is evaluated at each step: steps are customers, data sets are sources, entity types are their languages. Two strategies go over all steps, two over the first twenty."""
    steps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"))
    sets = documents(spark, sf_dir).select("source", F.array("lang").alias("types"))
    frames = [
        evaluate.rounds(steps if k in ("cycling", "random") else steps.where("step <= 20"), "step", sets, "source", "types", k, ("forum",)).withColumn("strategy", F.lit(k))
        for k in evaluate.STRATEGIES
    ]
    return union_all(frames).select("strategy", "step", "dataset", "examples", F.array_join("types", ",").alias("types"))


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {DRAW}, doc_id) <= 3")
def group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source, drawn by hash (a sampling operator)."""
    return sampling.per_group(documents(spark, sf_dir), "source", "doc_id", 3).select("doc_id", "source")


@query(f"SELECT doc_id FROM documents ORDER BY {DRAW}, doc_id LIMIT 50")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, drawn by hash (a sampling operator)."""
    return hash_sample(documents(spark, sf_dir), "doc_id", 50).select("doc_id")


UNIFORM = f"((('0x' || substr({DRAW}, 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"


@query(f"WITH u AS (SELECT doc_id, {UNIFORM} AS u FROM documents) SELECT doc_id, CASE WHEN u <= 0.2 THEN 'market' WHEN u <= 0.4 THEN 'voyage' WHEN u <= 0.55 THEN 'terms' ELSE 'other' END AS category FROM u")
def weighted_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = sampling.weighted_choice("doc_id", {"market": 20, "voyage": 20, "terms": 15, "other": 45})
    return documents(spark, sf_dir).select("doc_id", choice.alias("category"))


@query(f"WITH u AS (SELECT doc_id, n_chars, {UNIFORM} AS u FROM documents) SELECT doc_id FROM u ORDER BY -ln(u) / (1 + n_chars), doc_id LIMIT 40")
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty documents without replacement, longer ones more likely (a sampling operator)."""
    return sampling.weighted_without_replacement(documents(spark, sf_dir), 1 + F.col("n_chars"), "doc_id", 40).select("doc_id")


@query(f"SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY {DRAW}, doc_id) - 1) // 4)::BIGINT AS batch, source FROM documents")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four documents of one source, in an order drawn by hash; a source is ranked by ranges of the draw."""
    from textmill.operators.diversity import ranked

    place = F.conv(F.substring(sampling.draw("doc_id"), 1, 15), 16, 10).cast("long")
    placed = ranked(documents(spark, sf_dir).withColumn("place", place), ["source"], "place", width=1 << 52)
    return placed.select("doc_id", F.floor((F.col("rank") - 1) / 4).alias("batch"), "source")
