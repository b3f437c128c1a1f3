"""Column functions on text: tokens, n-grams, normal forms, names, URLs, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
NER_TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S"
ONE_SIGN = r"^[!-/:-@\[-`{-~]$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column | str) -> Column:
    """Lower-cased words and runs of other signs, without single punctuation signs."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda x: ~x.rlike(ONE_SIGN))


def ner_tokens(text: Column | str) -> Column:
    """Words, with their hyphens and underscores, and single other signs."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(NER_TOKEN), F.lit(0))


def words(text: Column | str) -> Column:
    """Runs of characters other than blanks."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\S+"), F.lit(0))


def ngrams(items: Column, n: int, joiner: str = " ") -> Column:
    """All runs of n items, joined; empty if there are fewer."""

    def made(a: Column) -> Column:
        return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), joiner))).otherwise(F.array().cast("array<string>"))

    return let(items, made)


def chunks(items: Column, size: int) -> Column:
    """Consecutive slices of ``size`` items, the last one shorter; none of an empty array."""

    def made(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))
        return F.when(F.size(a) > 0, F.transform(starts, lambda i: F.slice(a, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))

    return let(items, made)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def windowed_ttr(items: Column, window: int = 25, step: int = 10) -> Column:
    """Mean type-token ratio of the full windows at 0, step, 2 * step, ...; a text that is too short has its plain ratio."""

    def made(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(a) - window, F.lit(step))
        share = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(a, i + 1, window))) / float(window))
        mean = F.aggregate(share, F.lit(0.0), lambda x, y: x + y) / F.size(share)
        return F.when(F.size(a) >= window, mean).otherwise(ratio(F.size(F.array_distinct(a)), F.size(a)))

    return let(items, made)


def compare_form(text: Column | str) -> Column:
    """Null and the word None as empty; lower case, single blanks, trimmed."""
    x = F.coalesce(F.nullif(col(text), F.lit("None")), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def lower_form(text: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(text))), F.lit(""))


def normalize_text(text: Column | str) -> Column:
    """Lower case, single blanks, and decimals that were split ("66 . 50") joined."""
    x = F.regexp_replace(F.lower(col(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(x, r"(\d+) ?\. ?(\d+)", "$1.$2"))


def collapse_blanks(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def sentences(text: Column | str) -> Column:
    """Trimmed sentences; an end is . ! or ? before blanks and an upper-case letter or the end of the text."""
    marked = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"([.!?]+)\s+(\p{Lu})", "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


#: Abbreviations that do not end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Capt", "Inc", "Ltd", "Co", "Corp", "Gen", "Sen", "Gov", "St", "vs", "etc", "approx", "dept", "est", "fig", "no", "vol")


def protected_sentences(text: Column | str, least: int = 15, whole_words: bool = True) -> Column:
    """Sentences of at least ``least`` characters; dots of ABBREVIATIONS don't end one. whole_words=False also protects inside words."""
    edge = r"(^|[^\p{L}\p{M}\p{N}_])" if whole_words else "()"
    hidden = F.regexp_replace(F.coalesce(col(text), F.lit("")), rf"(?i){edge}({'|'.join(ABBREVIATIONS)})\.", "$1$2\u0002")
    parts = F.split(F.regexp_replace(hidden, r"[.!?]+(\s+[A-Z])", "\u0001$1"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("\u0002"), F.lit(".")))), lambda x: F.length(x) >= least)


def truncate_words(text: Column | str, n: int = 150) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def preview(text: Column | str, n: int = 200) -> Column:
    x = col(text)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def syllables(text: Column | str) -> Column:
    """An estimate: groups of vowels."""
    return F.regexp_count(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[aeiouyäöüàâéèêëîïôûùóíúá]+"))


#: Names that are none, as patterns; the first are read in any case.
TEST_NAMES = (r"^TEST\d*$", r"^DENEME\d*$", r"^DEMO\d*$", r"^SAMPLE\d*$")
NONSENSE_NAMES = (r"^[A-Z]{1,3}$", r"^[A-Z]\d*$")
SHORT_CODE = r"^[A-Z]{2}\d+$"
SPECIAL_SIGNS = r"""[!@#$%^&*(){}\[\]|\\:";'<>?,./`~=+]"""
#: Words that stay upper-case in names.
NAME_ABBREVIATIONS = (
    "MS", "MV", "MT", "SS", "RV", "FV", "HMS", "USNS", "USCGC", "LNG", "LPG", "CEO", "II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "USA", "UK", "EU", "UAE", "US", "FRC", "WB2",
)
ROMAN = r"(?i)^(?:I{1,3}|IV|V|VI{0,3}|IX|X|XI{0,3})(?:$|[^\p{L}\p{N}_])"


def valid_name(name: Column | str) -> Column:
    """A plausible proper name: 4 to 50 characters, over two different ones, few special signs, no code or test name."""
    x = F.trim(col(name))
    letters, special = F.regexp_count(x, F.lit(r"\p{L}")), F.regexp_count(x, F.lit(SPECIAL_SIGNS))
    kinds = F.size(F.array_distinct(F.split(F.replace(x, F.lit(" "), F.lit("")), "")))
    bad = x.rlike(SHORT_CODE) & (F.length(x) <= 4)
    for p in TEST_NAMES:
        bad = bad | x.rlike(f"(?i){p}")
    for p in NONSENSE_NAMES:
        bad = bad | x.rlike(p)
    good = F.length(x).between(4, 50) & (kinds > 2) & (letters >= 2) & (special <= 0.3 * F.length(x)) & ~bad
    return F.coalesce(good, F.lit(False))


def title_case(text: Column | str) -> Column:
    """Each run of letters with a capital first letter."""
    runs = F.regexp_extract_all(col(text), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def name_format(name: Column | str, keep_upper: tuple[str, ...] = NAME_ABBREVIATIONS) -> Column:
    """Title case by word; abbreviations (also in brackets), roman numerals at the start of a word and short codes with digits are upper-case."""

    def one(w: Column) -> Column:
        up = F.upper(w)
        parts = F.regexp_extract_all(w, F.lit(r"[()]|[^()]+"), F.lit(0))
        in_brackets = F.array_join(F.transform(parts, lambda p: F.when(F.upper(p).isin(*keep_upper), F.upper(p)).otherwise(title_case(p))), "")
        code = (F.length(w) <= 4) & w.rlike(r"^[\p{L}\p{N}]+$")
        return (
            F.when(w.contains("(") & w.contains(")"), in_brackets)
            .when(up.isin(*keep_upper) | w.rlike(ROMAN) | (w.rlike(r"\p{N}") & code), up)
            .otherwise(title_case(w))
        )

    return F.array_join(F.transform(words(F.trim(col(name))), one), " ")


def normalize_url(url: Column | str) -> Column:
    """Lower case, no fragment, no final slashes, percent signs decoded, and for wiki titles blanks for underscores and no closing parenthesis."""
    x = F.regexp_replace(F.split_part(F.lower(col(url)), F.lit("#"), F.lit(1)), "/+$", "")
    x = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    return F.when(x.contains("/wiki/"), F.trim(F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), r"\s*\([^)]*\)$", ""))).otherwise(x)


#: Units that are joined to their number.
UNITS = ("km", "m", "cm", "mm", "nm", "mi", "ft", "kg", "g", "t", "mt", "dwt", "teu", "kn", "hp", "kw", "mw", "l", "bbl", "h", "min", "s")


def join_units(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"(\d) +({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})\b", "$1$2")


def parse_coordinates(text: Column | str) -> Column:
    """struct(latitude, longitude) of ``DDMM[NS] DDDMM[EW]`` in degrees; null if it is malformed."""
    x = F.trim(col(text))
    part = lambda i: F.regexp_extract(x, r"^(\d{2})(\d{2})([NS]) (\d{3})(\d{2})([EW])$", i)
    lat = (F.try_to_number(part(1), F.lit("99")).cast("double") + F.try_to_number(part(2), F.lit("99")).cast("double") / 60) * F.when(part(3) == "S", -1.0).otherwise(1.0)
    lon = (F.try_to_number(part(4), F.lit("999")).cast("double") + F.try_to_number(part(5), F.lit("99")).cast("double") / 60) * F.when(part(6) == "W", -1.0).otherwise(1.0)
    good = x.rlike(r"^\d{4}[NS] \d{5}[EW]$")
    return F.when(good, F.struct(lat.alias("latitude"), lon.alias("longitude")))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def term_count(text: Column, terms: tuple[str, ...]) -> Column:
    """How often the terms occur as substrings, each by itself, without overlaps."""
    total = F.lit(0)
    for t in terms:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
    return total


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
