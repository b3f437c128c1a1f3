"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Statistics of a text become a vector: log mean word length, square roots of the shares of symbols and of repeated words, share of
repeated lines, log number of words (shares of few words or lines are shrunk). For each language and source, a minimum covariance determinant estimate is found by
concentration steps from two starts (median and deviation from it; mean and standard deviation), the start of the least determinant is taken, and
the estimate is reweighted. A language and source with fewer than ``least`` documents that pass the base rules is judged by the estimate of its
language, and where the language has fewer by that of all rows, which has a wider floor if even they are few. A document is rejected if a base rule fails or its squared Mahalanobis distance is
over ``cutoff``. The covariance has a fixed diagonal floor, so statistics that do not vary in a group leave it regular.

Estimates have one row for each group; while these are at most BROADCAST_GROUPS they are broadcast to the documents, which then need no shuffle.
Beyond that, documents are dealt by group and one of SALTS numbers, so a large group is spread over many tasks.

Defined results: null texts count as empty (no words: base rule fails); a null language or source is a group of its own, apart from
the empty string; equal rows get equal verdicts; a group too small for any estimate has a null distance and is kept if the base rules pass; an empty table gives no
rows. Three-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Up to so many windows are sorted as packed integers; longer texts are sorted as pairs.
PACKED = 1 << 24
POSITION_BITS = 24
BROADCAST_GROUPS = 20_000
SALTS = 64
FEATURES = ("f_length", "f_symbols", "f_repeats", "f_lines", "f_words")
#: Standard deviations that are added to each feature's covariance.
FLOOR = (0.03, 0.04, 0.1, 0.06, 0.3)
SUBSET = 0.75
STEPS = 3
LEAST = 50
#: Chi-squared quantiles for five degrees of freedom: median, 0.975; and the distance that rejects.
CHI_MEDIAN, CHI_975, CUTOFF = 4.351, 12.833, 60.0
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more."""

    def covered(positions: Column) -> Column:
        gap = lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(positions, i + 1) - p, F.lit(3).cast("long")))
        return F.aggregate(F.transform(positions, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def neighbours(s: Column, same) -> Column:
        """The elements of s, sorted, that are the same as the one before or after."""
        test = lambda x, y: F.coalesce(same(x, y), F.lit(False))
        return F.filter(s, lambda x, i: F.when(i > 0, test(x, F.get(s, i - 1))).otherwise(F.lit(False)) | test(x, F.get(s, i + 1)))

    def of_hashes(hashes: Column) -> Column:
        place = F.lit((1 << POSITION_BITS) - 1).cast("long")
        upper = lambda h: F.shiftright(h, POSITION_BITS)
        # candidates share the upper bits of their hashes with another window
        packed = F.transform(hashes, lambda h, i: F.shiftleft(upper(h), POSITION_BITS).bitwiseOR(i.cast("long")))
        few = let(F.sort_array(packed), lambda s: neighbours(s, lambda x, y: upper(x) == upper(y)))
        few = F.transform(few, lambda x: F.struct(F.get(hashes, x.bitwiseAND(place).cast("int")).alias("h"), x.bitwiseAND(place).alias("i")))
        every = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
        candidates = F.when(F.size(hashes) <= PACKED, few).otherwise(every)
        found = let(F.sort_array(candidates), lambda s: neighbours(s, lambda x, y: x["h"] == y["h"]))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows(words), of_hashes))


def statistics(text: Column) -> Column:
    """A struct of STATS; long integers."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    made = (F.ln(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / (n + 50)), F.col("n_dup_lines") / (F.col("n_lines") + 5), F.ln(n))
    return [c.cast("double").alias(name) for c, name in zip(made, FEATURES)]


def distance() -> Column:
    """Squared Mahalanobis distance from columns m_i and the inverse Cholesky factor v_i_j."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"v_{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}"))
        total = total + y * y
    return total


def whitened(moments: DataFrame) -> DataFrame:
    """From columns m_i and c_i_j: adds log_det and v_i_j, the inverse of the Cholesky factor; drops c_i_j."""
    d = len(FEATURES)
    out = moments

    def lower(i: int, j: int) -> Column:
        s = F.col(f"c_{i}_{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
        for k in range(j):
            s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        return F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l_{j}_{j}")

    def inverse(i: int, j: int) -> Column:
        s = F.lit(1.0 if i == j else 0.0)
        for k in range(j, i):
            s = s - F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}")
        return s / F.col(f"l_{i}_{i}")

    for j in range(d):
        out = out.withColumn(f"l_{j}_{j}", lower(j, j))
        if j + 1 < d:
            out = out.withColumns({f"l_{i}_{j}": lower(i, j) for i in range(j + 1, d)})
    for i in range(d):
        out = out.withColumns({f"v_{i}_{j}": inverse(i, j) for j in range(i + 1)})
    log_det = sum((2 * F.ln(f"l_{i}_{i}") for i in range(d)), F.lit(0.0))
    return out.withColumn("log_det", log_det).drop(*[f"{x}_{i}_{j}" for x in "cl" for i in range(d) for j in range(i + 1)])


def wider(covariance: Column, i: int, j: int, n: Column, least: float) -> Column:
    """Fewer than ``least`` rows count the floor ``least`` / n times."""
    return covariance + (F.greatest(least / n - 1, F.lit(0.0)) * FLOOR[i] ** 2 if i == j else 0.0)


def moments(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    d = range(len(FEATURES))
    means = [F.avg(FEATURES[i]).alias(f"m_{i}") for i in d]
    cells = [wider(F.covar_pop(FEATURES[i], FEATURES[j]), i, j, F.count("*"), least).alias(f"c_{i}_{j}") for i in d for j in range(i + 1)]
    return rows.groupBy(*by).agg(*means, *cells)


def log_distance(d2: Column) -> Column:
    """Rounded, so that a group has few distinct values and quantiles are exact and cheap."""
    return F.round(F.ln(d2 + 1e-6), 3)


def with_groups(rows: DataFrame, per_group: DataFrame, by: list[str], groups: int) -> DataFrame:
    """rows joined with the one row of ``per_group`` for their group; ``groups`` is how many there are at most."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(per_group), by)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f) for f in FEATURES]), F.lit(SALTS)))
    copies = per_group.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, [*by, "__salt"]).drop("__salt")


def robust_estimates(points: DataFrame, group: list[str], enough: Column, few: bool = False, subset: float = SUBSET, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """For each group of ``points`` (with FEATURES) whose number of rows n is ``enough``: the estimate's m_i and v_i_j. ``few``: small groups count a wider floor."""
    d = range(len(FEATURES))
    widen = subset * least if few else 0.0
    medians = [F.percentile(F.round(f, 3), F.lit(0.5)).alias(f"p_{i}") for i, f in enumerate(FEATURES)]
    means = [F.avg(f).alias(f"a_{i}") for i, f in enumerate(FEATURES)]
    deviations = [F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    middle = cut_lineage(points.groupBy(*group).agg(F.count("*").alias("n"), *medians, *means, *deviations).where(enough))
    groups = middle.count()
    told = lambda rows, table, by: with_groups(rows, table, by, groups)
    spread = told(points, middle, group).groupBy(*group).agg(
        *[F.percentile(F.round(F.abs(F.col(f) - F.col(f"p_{i}")), 3), F.lit(0.5)).alias(f"q_{i}") for i, f in enumerate(FEATURES)]
    )
    both = cut_lineage(middle.join(spread, group))

    def diagonal(start: int, centre: str, deviation: str, factor: float) -> DataFrame:
        cells = [
            wider(F.pow(F.col(f"{deviation}_{i}") * factor, 2) if i == j else F.lit(0.0), i, j, F.col("n"), least).alias(f"c_{i}_{j}")
            for i in d for j in range(i + 1)
        ]
        return both.select(*group, F.lit(start).alias("start"), *[F.col(f"{centre}_{i}").alias(f"m_{i}") for i in d], *cells)

    now = cut_lineage(whitened(diagonal(0, "p", "q", 1.4826).unionByName(diagonal(1, "a", "s", 1.0))))
    by = [*group, "start"]
    for _ in range(steps):
        far = told(points, now, group).withColumn("far", log_distance(distance())).select(*by, *FEATURES, "far")
        limit = far.groupBy(*by).agg(F.percentile("far", F.lit(subset)).alias("limit"))
        near = told(far, limit, by).where("far <= limit")
        now = cut_lineage(whitened(moments(near, by, widen)))
    best = now.groupBy(*group).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    now = now.join(best, by).drop("start", "log_det")
    far = told(points, now, group).withColumn("far", log_distance(distance())).select(*group, *FEATURES, "far")
    scale = far.groupBy(*group).agg((F.exp(F.percentile("far", F.lit(0.5))) / CHI_MEDIAN).alias("scale"))
    inside = told(far, scale, group).where(F.exp("far") <= CHI_975 * F.greatest("scale", F.lit(1e-6))).select(*group, *FEATURES)
    final = whitened(moments(inside, group, widen)).drop("log_det")
    return cut_lineage(final)


def estimates(points: DataFrame, groups: DataFrame, least: int = LEAST) -> DataFrame:
    """For each lang and source of ``groups``: the m_i and v_i_j of its own documents in ``points``, or of its language, or of all."""
    by = ["lang", "source"]
    own = robust_estimates(points, by, F.col("n") >= least, least=least)
    without = cut_lineage(groups.join(own, by, "left_anti"))
    if without.isEmpty():
        return own
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("lang").alias("name")), F.struct(F.lit(1).alias("level"), F.lit("").alias("name")))
    wanted = cut_lineage(without.select(F.inline(levels)).distinct())
    pooled = with_groups(points.select(*FEATURES, F.inline(levels)), wanted, ["level", "name"], wanted.count())
    pooled = robust_estimates(pooled, ["level", "name"], (F.col("n") >= least) | (F.col("level") == 1), True, least=least)
    fit = F.struct(*[c for c in own.columns if c not in by])
    of_lang = pooled.where("level = 0").select(F.col("name").alias("lang"), fit.alias("of_lang"))
    of_all = pooled.where("level = 1").select(fit.alias("of_all"))  # one row at most
    borrowed = without.join(of_lang, "lang", "left").join(F.broadcast(of_all), how="left").select(*by, F.coalesce("of_lang", "of_all").alias("fit"))
    return cut_lineage(own.unionByName(borrowed.select(*by, "fit.*")))


def row_hash(*columns: Column | str) -> Column:
    """Of values and of which are null."""
    return F.xxhash64(*columns, *[F.isnull(c) for c in columns])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """One row for each of df: key, STATS, base_failed, distance (null without an estimate), kept, and __row, a hash of text, language and source."""
    identity = row_hash(text, lang, source)
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null is no name at all
    stats = df.select(F.col(key).alias("__key"), named(lang).alias("lang"), named(source).alias("source"), identity.alias("__row"), F.inline(F.array(statistics(F.col(text)))))
    points = cut_lineage(stats.withColumn("base_failed", base_failed()).select("*", *features()))
    groups = cut_lineage(points.select("lang", "source").distinct())
    final = estimates(points.where("not base_failed").select("lang", "source", *FEATURES), groups, least)
    # every group has a row, with nulls where no estimate could be made
    known = cut_lineage(groups.join(final, ["lang", "source"], "left"))
    judged = with_groups(points, known, ["lang", "source"], known.count()).withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select(F.col("__key").alias(key), *STATS, "base_failed", "distance", kept.alias("kept"), "__row")


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """df without the rejected rows; all columns stay."""
    bad = judge(df, text, lang, source, key).where("not kept").select(F.col(key).alias("__key"), "__row").distinct()
    return df.join(bad, df[key].eqNullSafe(bad["__key"]) & (row_hash(df[text], df[lang], df[source]) == bad["__row"]), "left_anti")
