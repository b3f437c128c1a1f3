"""Term scores, rejection reasons, segments and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as fx

#: Catalogues are parameters: (category, weight, pattern). These stand for a domain vocabulary, good and bad signs of prose.
DOMAIN = (("terms", 2.0, r"(?i)[^\p{L}](?:the|der|la|el)[^\p{L}]"), ("links", 1.0, r"(?i)[^\p{L}](?:and|und|et|y)[^\p{L}]"), ("places", 1.0, r"(?i)[^\p{L}](?:in|auf|dans|en)[^\p{L}]"))
GOOD = (r"(?i)[^\p{L}](?:that|which|dass|que)[^\p{L}]", r"[.!?]\s", r",\s")
BAD = (r"[#$%&*]{2,}", r"[A-Z]{5,}", r"(?i)lorem ipsum", r"!!+")


def pattern_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def domain_relevance(text: Column, catalogue=DOMAIN) -> Column:
    """Weighted matches a word."""
    total = F.lit(0.0)
    for _, weight, pattern in catalogue:
        total = total + weight * pattern_count(text, pattern)
    return fx.ratio(total, F.size(fx.words(text)))


def quality_score(text: Column, good=GOOD, bad=BAD) -> Column:
    """(good - bad) matches a word; -1 for a text without words."""
    total = F.lit(0)
    for p in good:
        total = total + pattern_count(text, p)
    for p in bad:
        total = total - pattern_count(text, p)
    n = F.size(fx.words(text))
    return F.when(n == 0, F.lit(-1.0)).otherwise(total / n)


def weighted_term_score(text: Column, primary: tuple[str, ...], entity: tuple[str, ...], secondary: tuple[str, ...], veto: tuple[str, ...] = (), veto_least: int = 2) -> Column:
    """(3 primary + 2 entity + secondary) / (words + 100) * 20, at most 1; 0.01 if enough veto terms occur. Substrings of the lower-cased text."""
    x = F.lower(text)
    score = (3 * fx.term_count(x, primary) + 2 * fx.term_count(x, entity) + fx.term_count(x, secondary)) / (F.size(fx.words(text)) + 100) * 20
    vetoed = sum((F.contains(x, F.lit(t)).cast("int") for t in veto), F.lit(0)) >= veto_least
    return F.when(vetoed, F.lit(0.01)).otherwise(F.least(F.lit(1.0), score))


def rejection_reason(text: Column, limits: dict | None = None) -> Column:
    """The first rule that fails, or null."""
    limit = {"chars": (50, 8192), "words": (10, 1200), "sentences": 2, "relevance": 0.005, "quality": -0.02} | (limits or {})
    n, m = F.length(text), F.size(fx.words(text))
    return (
        F.when(n < limit["chars"][0], "too_short").when(n > limit["chars"][1], "too_long").when(m < limit["words"][0], "too_few_words").when(m > limit["words"][1], "too_many_words")
        .when(F.size(fx.sentences(text)) < limit["sentences"], "too_few_sentences").when(domain_relevance(text) < limit["relevance"], "not_relevant").when(quality_score(text) < limit["quality"], "low_quality")
    )


def segments(sentences: Column, budget: int = 800) -> Column:
    """Sentences folded greedily into segments: a sentence that would pass the word budget starts a new one.

    The fold goes over the numbers of words and notes where segments start; texts are joined once at the end.
    """

    def fold(ss: Column) -> Column:
        sizes = F.transform(ss, lambda s: F.regexp_count(s, F.lit(r"\S+")))

        def add(state: Column, size: Column) -> Column:
            over = (state["n"] + size > budget) & (state["n"] > 0)
            starts = F.when(over, F.array_append(state["starts"], state["i"])).otherwise(state["starts"])
            return F.struct(starts.alias("starts"), (state["i"] + 1).alias("i"), F.when(over, size).otherwise(state["n"] + size).alias("n"))

        begin = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"))
        starts = F.aggregate(sizes, begin, add, lambda st: st["starts"])

        def joined(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(ss)))
            return F.zip_with(at, ends, lambda a, b: F.array_join(F.slice(ss, a + 1, b - a), " "))

        return F.when(F.size(ss) > 0, fx.let(starts, joined)).otherwise(F.array().cast("array<string>"))

    return fx.let(sentences, fold)


def overlapping_chunks(sentences: Column, target: int = 400, most: int = 600, overlap: int = 2, least: int = 100) -> Column:
    """Chunks of about ``target`` characters: array of struct(start, end, text).

    A chunk closes before a sentence that would pass ``most``, or after one that reaches ``target``; the next one starts
    ``overlap`` sentences earlier (but after the last start). A tail shorter than ``least`` joins the chunk before it.
    """
    state = "struct<out:array<struct<start:int,end:int>>,start:int,n:int>"
    first = F.from_json(F.lit('{"out":[],"start":0,"n":0}'), state)

    def fold(ss: Column) -> Column:
        def add(st: Column, i: Column) -> Column:
            size = F.length(F.get(ss, i))
            full = (st["n"] > 0) & (st["n"] + size > most)
            closed = F.when(full, i - 1).when(st["n"] + size >= target, i)
            start = F.when(full, F.greatest(i - overlap, st["start"] + 1)).when(closed.isNotNull(), F.greatest(i + 1 - overlap, st["start"] + 1)).otherwise(st["start"])
            out = F.when(closed.isNotNull(), F.array_append(st["out"], F.struct(st["start"].alias("start"), closed.cast("int").alias("end")))).otherwise(st["out"])
            span = F.aggregate(F.slice(ss, start + 1, F.greatest(i + 1 - start, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x))
            return F.struct(out.alias("out"), start.cast("int").alias("start"), F.when(closed.isNotNull(), span).otherwise(st["n"] + size).cast("int").alias("n"))

        def finish(st: Column) -> Column:
            last, tail = F.size(ss) - 1, F.coalesce(F.try_element_at(F.transform(st["out"], lambda x: x["end"]), F.lit(-1)), F.lit(-1)) < F.size(ss) - 1
            own = F.struct(st["start"].alias("start"), last.cast("int").alias("end"))
            short = (st["n"] < least) & (F.size(st["out"]) > 0)
            joined = F.transform(st["out"], lambda x, k: F.struct(x["start"].alias("start"), F.when(k == F.size(st["out"]) - 1, last.cast("int")).otherwise(x["end"]).alias("end")))
            return F.when(~tail, st["out"]).when(short, joined).otherwise(F.array_append(st["out"], own))

        spans = F.aggregate(F.sequence(F.lit(0), F.size(ss) - 1), first, add, finish)
        texts = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_join(F.slice(ss, x["start"] + 1, x["end"] - x["start"] + 1), " ").alias("text")))
        return F.when(F.size(ss) > 0, texts).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,end:int,text:string>>"))

    return fx.let(sentences, fold)


def rejections(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents by reason, and their share."""
    made = df.select(F.coalesce(rejection_reason(F.col(text)), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("docs"))
    total = made.agg(F.sum("docs").alias("total"))
    return made.join(F.broadcast(total)).select("reason", "docs", (F.col("docs") * 100.0 / F.col("total")).alias("percent"))
