"""Articles of an encyclopaedia: which pages belong to a domain, their text, their relevance, and the corpus made of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators.elements import page_parts
from textmill.operators.quality import weighted_term_score

#: Words of a title, of a category and of an address that speak for the domain, and headers of sections without prose.
TITLE_WORDS = (
    "port of ", "shipping", "maritime", "vessel", "cargo", "tanker", "container", "seaport", "harbor", "harbour", "terminal", "dock", "wharf", "bulk carrier", "shipyard", "freight",
    "charter", "ocean", "tonnage", "shipowner",
)
CATEGORY_WORDS = (
    "shipping", "port", "maritime", "transport", "logistics", "navigation", "nautical", "naval architecture", "merchant", "waterborne", "vessel", "boat", "terminal", "dock", "ship",
)
ADDRESS_WORDS = ("port", "terminal", "harbour", "harbor")
PLACE_WORDS = ("port of", "harbor", "harbour", "terminal", "dock")
NO_PROSE = ("References", "See also", "External links")


class Terms(NamedTuple):
    """Vocabulary of the domain, and words that speak against it."""

    primary: tuple[str, ...]
    entity: tuple[str, ...]
    secondary: tuple[str, ...]
    veto: tuple[str, ...] = ()
    veto_least: int = 2


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w))
    return F.coalesce(hit, F.lit(False))


def related(text: Column, terms: Terms, least_score: float | Column = 0.035, least_primary: int = 1) -> Column:
    """Whether a text has the relevance and the primary terms asked for; a vetoed text has no primary terms."""
    x = F.lower(F.coalesce(text, F.lit("")))
    vetoed = sum((F.contains(x, F.lit(t)).cast("int") for t in terms.veto), F.lit(0)) >= terms.veto_least
    primary = F.when(vetoed, 0).otherwise(fx.term_count(x, terms.primary))
    return (weighted_term_score(x, *terms) >= least_score) & (primary >= least_primary)


def articles(df: DataFrame, html: str, url: str, keep: tuple[str, ...], terms: Terms, blocked: tuple[str, ...] = ()) -> DataFrame:
    """keep, url, title, categories, content and relevance of the pages that belong to the domain.

    A page goes if it has no body or is in a blocked category. Otherwise it stays for a word in its title or in a category, or for its first three paragraphs, or for its first ten
    with a lower score. Text is the paragraphs, then each section's header and paragraphs, without tables, notes and boxes. Title and categories give a least relevance.
    """
    said = page_parts(df, html, (*keep, url))
    title = F.coalesce("title", F.lit("Unknown"))
    listed = lambda words: F.exists("categories", lambda c: any_in(c, words)) if words else F.lit(False)
    joined = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p, F.lit("\n\n"))), "")
    by_title, by_category = any_in(F.col("title"), TITLE_WORDS), listed(CATEGORY_WORDS)
    first = F.when(any_in(F.col(url), ADDRESS_WORDS), 0.015).otherwise(0.035)
    gate = by_title | by_category | related(joined(F.slice("lead", 1, 3)), terms, first) | related(joined(F.col("lead")), terms, 0.015)
    none = tuple(b.replace("Category:", "").replace("_", " ").lower() for b in blocked)
    shown = lambda s: (s["header"] != "") & ~sum((F.contains(s["header"], F.lit(w)).cast("int") for w in NO_PROSE), F.lit(0)).cast("boolean")
    section = lambda s: F.concat(F.lit("\n\n"), s["header"], F.lit("\n\n"), joined(s["paragraphs"]))
    content = F.concat(joined(F.col("paragraphs")), F.array_join(F.transform(F.filter("sections", shown), section), ""))
    kept = said.where(F.col("has_body") & ~listed(none)).where(gate)
    made = kept.select(*keep, url, title.alias("title"), "categories", content.alias("content"))
    known = any_in(F.col("title"), TITLE_WORDS)
    floor = F.greatest(F.when(known, 0.7).otherwise(0.0), F.when(listed(CATEGORY_WORDS), 0.5).otherwise(0.0), F.when(any_in(F.col("title"), PLACE_WORDS), 0.8).otherwise(0.0))
    return made.withColumn("relevance", F.greatest(weighted_term_score(F.col("content"), *terms), floor))


def corpus(df: DataFrame, least: float = 0.05) -> DataFrame:
    """(text, title, url, relevance): articles of at least this relevance, the most relevant first, then by address."""
    kept = df.where(F.col("relevance") >= least)
    return kept.select(F.col("content").alias("text"), "title", "url", "relevance").orderBy(F.desc("relevance"), "url")
