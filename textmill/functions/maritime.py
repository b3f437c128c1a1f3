"""The maritime domain: catalogues of patterns, and the scores, sentence checks and blocked addresses that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions import text as fx

#: Patterns of the domain by category, read in any case; matches of two of the categories count twice.
DOMAIN = {
    "measurements": (
        r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:DWT|dwt|deadweight)\b", r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:TEU|teu)\b", r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:tonnes?|tons?|metric\s+tons?)\b",
        r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:metres?|meters?|ft|feet|km|kilometres?|kilometers?|mi|miles?)\b", r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:knots?|mph|km/h)\b",
    ),
    "currency_trade": (
        r"US\$\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:billion|million|thousand))?", r"\$\d+(?:,\d{3})*(?:\.\d+)?\s*(?:per|/)", r"LE\s*\d+(?:,\d{3})*(?:\.\d+)?", r"cost\s+of.*?\$\d+(?:,\d{3})*(?:\.\d+)?",
    ),
    "maritime_terms": (
        r"\b(?:charter-?party|charterparty|charterer|shipowner)\b", r"\b(?:demurrage|laytime|despatch|freight)\b", r"\b(?:vessel|ship|tanker|carrier|bulk\s+carrier|container\s+ship)\b",
        r"\b(?:port|harbour|harbor|terminal|berth|wharf)\b", r"\b(?:cargo|freight|shipment|loading|unloading|discharge)\b", r"\b(?:maritime|shipping|navigation|seaborne)\b",
        r"\b(?:Incoterms?|FOB|CIF|FAS|CFR|EXW|DAP|DDP)\b", r"\b(?:bill\s+of\s+lading|B/L|BOL|waybill)\b",
    ),
    "ship_types": (
        r"\b(?:oil\s+tanker|chemical\s+tanker|gas\s+carrier|LPG\s+carrier|LNG\s+carrier)\b", r"\b(?:bulk\s+carrier|bulker|container\s+ship|boxship|containership)\b",
        r"\b(?:reefer\s+ship|RORO|ro-ro|roll-on/roll-off)\b", r"\b(?:multi-purpose\s+vessel|MPV|handysize|handymax|supramax)\b", r"\b(?:ULCC|VLCC|suezmax|aframax|panamax)\b",
    ),
    "geographical": (
        r"\b(?:Strait\s+of\s+Malacca|Malacca\s+Strait)\b", r"\b(?:Suez\s+Canal|Panama\s+Canal)\b", r"\b(?:Mediterranean\s+Sea|Red\s+Sea|Arabian\s+Sea|South\s+China\s+Sea)\b",
        r"\b(?:Port\s+Said|Port\s+Tewfik|Singapore|Rotterdam|Shanghai)\b",
    ),
}
TWICE = ("maritime_terms", "ship_types")
#: Good signs, bad signs and structure that is left over, read in any case.
GOOD = (
    r"\b(?:contract|agreement|terms|conditions)\b", r"\b(?:operated|maintained|constructed|designed)\b", r"\b(?:capacity|efficiency|transport|carriage)\b",
    r"\b(?:international|commercial|trade|business)\b", r"\b(?:according\s+to|under\s+the|in\s+accordance\s+with)\b",
)
BAD = (
    r"click\s+here|read\s+more|see\s+also|more\s+information", r"this\s+article|this\s+page|above\s+mentioned|as\s+mentioned", r"copyright|all\s+rights\s+reserved|terms\s+of\s+use", r"^\s*$|^\.+$|^\d+\.$",
    r"lorem\s+ipsum|placeholder|example\s+text", r"edit\s+this\s+page|update\s+needed|stub\s+article",
)
STRUCTURE = (r"^[^a-zA-Z]*$", r"^.{1,10}$", r"(.)\1{10,}", r"[^\w\s\.,;:!?()-]{5,}")
#: Categories and endings of addresses that are not followed.
BLOCKED_CATEGORIES = tuple(
    f"Category:{name}" for name in (
        "Racehorses", "Thoroughbred", "Horse", "Horses", "Individual_horses", "Fictional_horses", "Horse_racing", "People", "Biography", "Films", "Television", "Music", "Books", "Novels", "Video_games",
        "Artists", "Politicians", "Sportspeople", "Actors", "Medicine", "Medical_terms", "Health", "Diseases", "Anatomy", "Physiology", "Surgery", "Healthcare", "Physicians", "Hospitals", "Biology", "Physics",
        "Chemistry", "Astronomy", "Religion", "Philosophy", "Military_history", "Military_operations", "Fiction", "Literature", "Mythology", "Gaming", "Sports",
    )
)
BLOCKED_ENDINGS = (
    "horse", "racehorse", "footballer", "actor", "musician", "album", "film", "TV_series", "singer", "writer", "disease", "medicine", "medical", "biology", "anatomy", "military", "novel", "mythology", "religion",
)
BLOCKED_PATTERNS = tuple(rf"_\({name}\)" for name in BLOCKED_ENDINGS)
#: Any case, Unicode classes, only line feeds as line ends.
FLAGS = "(?iUd)"


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return sum((F.regexp_count(text, F.lit(FLAGS + p)) for p in patterns), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def relevance(text: Column) -> Column:
    """Matches of the domain a word, those of TWICE counted twice; 0 without words."""
    x = F.coalesce(text, F.lit(""))
    total = sum((matches(x, ps) * (2 if name in TWICE else 1) for name, ps in DOMAIN.items()), F.lit(0))
    return fx.ratio(total, words(x))


def quality(text: Column) -> Column:
    """Good less bad signs a word; -1 without words."""
    x = F.coalesce(text, F.lit(""))
    return F.when(words(x) == 0, F.lit(-1.0)).otherwise((matches(x, GOOD) - matches(x, BAD)) / words(x))


def valid_sentence(sentence: Column) -> Column:
    """At least three words and a run of three letters, no structure that is left over and no bad sign."""
    ok = (words(sentence) >= 3) & sentence.rlike("[a-zA-Z]{3,}")
    for p in STRUCTURE + BAD:
        ok = ok & ~sentence.rlike(FLAGS + p)
    return F.coalesce(ok, F.lit(False))


def scored(df: DataFrame, text: str) -> DataFrame:
    """df with relevance, quality, sentences (valid ones) and rejection: the first rule of length, words, sentences, relevance and quality that a text fails, or null.

    Each pattern is matched once a text: the measures travel as one array, which the rules read.
    """
    x = F.col(text)
    n, m, count, near, fine = (F.col("__m")[i] for i in range(5))
    good = F.size(F.filter(fx.protected_sentences(x), valid_sentence))
    total = sum((matches(x, ps) * (2 if name in TWICE else 1) for name, ps in DOMAIN.items()), F.lit(0))
    signs = matches(x, GOOD) - matches(x, BAD)
    measures = F.array(*[c.cast("long") for c in (F.length(x), words(x), good, total, signs)])
    rows = df.withColumn("__m", measures)
    relevance, quality = fx.ratio(near, F.coalesce(m, F.lit(0))), F.when(F.coalesce(m, F.lit(0)) == 0, F.lit(-1.0)).otherwise(fine / m)
    rule = (
        F.when(n < 50, "too_short").when(n > 8192, "too_long").when(m < 10, "too_few_words").when(m > 1200, "too_many_words").when(count < 2, "too_few_sentences")
        .when(relevance < 0.005, "not_maritime_relevant").when(quality < -0.02, "low_quality")
    )
    return rows.select(*df.columns, relevance.alias("relevance"), quality.alias("quality"), count.cast("int").alias("sentences"), rule.alias("rejection"))
