"""Labels and their formats: aliases, names of data sets, span formats, training answers, annotations of chunks, filters of sentences and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as fx

#: The names under which a label may stand, in order.
ALIASES = {
    "vessel": ("vessel", "vessel_name", "ship_name", "ship", "vessel_id"),
    "commodity": ("commodity",),
    "incoterm": ("incoterm", "terms", "trade_terms", "delivery_terms"),
    "load_port": ("load_port",),
    "discharge_port": ("discharge_port",),
}
#: Words in a path, all of which must occur, and what they stand for; the first that fits counts.
METHODS = (
    (("attrprompting",), "Attr Prompting"), (("baserefine", "llama3b"), "Bare Llama3B"), (("baserefine", "llama8b"), "Bare Llama8B"), (("fewshot",), "Fewshot"), (("zeroshot",), "Zeroshot"),
)
MODELS = ((("claude",), "Claude"), (("deepseek",), "Deepseek"), (("gemini",), "Gemini"), (("gpt-4",), "GPT4"), (("gpt4",), "GPT4"), (("mistral",), "Mistral"))
DATASETS = (
    (("attr_prompting",), "AttrPrompting"), (("bare_llama_3b",), "BARE (Llama 3B)"), (("bare_llama_8b",), "BARE (Llama 8B)"), (("fewshot",), "Few-shot"), (("zeroshot",), "Zero-shot"),
)
SINGLE = ("vessel", "commodity", "incoterm")


def labels_of(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> list[Column]:
    """Each label from the first of its names that df has and that is not empty; null without one."""
    made = []
    for label, names in aliases.items():
        present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        made.append((F.coalesce(*present) if present else F.lit(None).cast("string")).alias(label))
    return made


def named_by(text: Column, table: tuple, other: str = "Unknown") -> Column:
    """The first name of a table whose words all occur in the lower-cased text."""
    x, out = F.lower(text), F.lit(other)
    for needed, name in reversed(table):
        hit = F.lit(True)
        for w in needed:
            hit = hit & F.contains(x, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def dataset_parts(name: Column) -> list[Column]:
    """Kind and model of a data set: the model is the last part between underscores, or the whole of an unknown kind."""
    kind = named_by(name, DATASETS)
    last = F.when(kind == "Unknown", name).otherwise(F.element_at(F.split(name, "_"), -1))
    model = F.when(F.lower(last) == "gpt", "GPT").when(F.lower(last) == "deepseek", "DeepSeek").otherwise(F.concat(F.upper(F.substring(last, 1, 1)), F.lower(F.substring(last, 2, 1 << 20))))
    return [kind.alias("kind"), model.alias("model")]


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which none of the labels is null, empty or blank."""
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) != "")
    return df.where(ok)


def split_last(name: Column) -> list[Column]:
    """What stands before the last underscore, and after it."""
    pattern = r"^(.*)_([^_]*)$"
    return [F.regexp_extract(name, pattern, 1).alias("method"), F.regexp_extract(name, pattern, 2).alias("model")]


def renamed(spans: Column, names: dict[str, str]) -> Column:
    """Spans (start, end, type) with lower-cased types, renamed by the map where it knows them."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None

    def one(s: Column) -> Column:
        kind = F.lower(s["type"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.coalesce(F.try_element_at(known, kind), kind) if names else kind).alias("type"))

    return F.transform(spans, one)


def flat_spans(entities: Column) -> Column:
    """(start, end, type) of entities with ``pos`` (a pair) or start and end; entities without place or type go."""
    made = F.transform(entities, lambda e: F.struct(
        F.coalesce(F.get(e["pos"], F.lit(0)), e["start"]).alias("start"), F.coalesce(F.get(e["pos"], F.lit(1)), e["end"]).alias("end"), e["type"].alias("type"),
    ))
    return F.filter(made, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["type"].isNotNull())


def answer(annotations: Column) -> Column:
    """The JSON answer of a training example from "text <> type" annotations: the last vessel, commodity and incoterm, and all locations."""
    pairs = F.transform(F.filter(annotations, lambda a: a.contains(" <> ")), lambda a: F.struct(
        F.split_part(a, F.lit(" <> "), F.lit(1)).alias("text"), F.lower(F.trim(F.regexp_replace(a, r"(?s)^.*? <> ", ""))).alias("type"),
    ))

    def built(p: Column) -> Column:
        of = lambda kind: F.transform(F.filter(p, lambda x: x["type"] == kind), lambda x: x["text"])
        last = [F.try_element_at(of(kind), F.lit(-1)).alias(kind) for kind in SINGLE]
        return F.to_json(F.struct(*last, of("location").alias("locations")), {"ignoreNullFields": "false"})

    return fx.let(pairs, built)


def share_found(text: Column, entities: Column) -> Column:
    """The share of "text <> type" entities whose text occurs in the text, in any case; 1 without entities."""
    low = F.lower(text)
    hits = F.filter(entities, lambda e: e.contains(" <> ") & low.contains(F.lower(F.split_part(e, F.lit(" <> "), F.lit(1)))))
    return F.when(F.size(entities) == 0, F.lit(1.0)).otherwise(F.size(hits) / F.size(entities))


def annotated(chunks: DataFrame, annotations: DataFrame, keys: list[str], text: str = "text", entities: str = "entities", threshold: float = 0.1, also: list[str] | None = None) -> DataFrame:
    """Chunks with their annotations where at least ``threshold`` of these are in the text.

    If more than a tenth of the matches fail and the key ``also`` gives more rows, that key is taken instead.
    """

    def joined(by: list[str]) -> tuple[DataFrame, int, int]:
        both = chunks.join(annotations.select(*by, entities), by).withColumn("__good", share_found(F.col(text), F.col(entities)) >= threshold)
        n = both.agg(F.count("*").alias("n"), F.count_if("__good").alias("good")).first()
        return both.where("__good").drop("__good"), n["n"], n["good"]

    made, n, good = joined(keys)
    if also and n - good > 0.1 * n:
        other, _, more = joined(also)
        if more > good:
            return other
    return made


def harvested(text: Column, values: Column) -> Column:
    """Distinct "value <> type" of a map type -> value whose value occurs in the text."""
    found = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull() & (e["value"] != "") & text.contains(e["value"]))
    return F.array_distinct(F.transform(found, lambda e: F.concat(e["value"], F.lit(" <> "), e["key"])))


#: Patterns, in any case, that a sentence may not hold: structure that is left over, and signs of bad text. A choice of our own, not a catalogue to match; the operator takes others.
STRUCTURE = (r"^\s*[|*#]", r"={2,}", r"\{\{|\}\}", r"^\s*[0-9]+\.?\s*$")
BAD_SIGNS = (r"^\s*see also", r"retrieved on", r"click here", r"isbn [0-9-]+", r"https?://", r"[%#$&*]{2,}")


def good_sentence(sentence: Column, bad: tuple[str, ...] = STRUCTURE + BAD_SIGNS, least_words: int = 3) -> Column:
    """At least three words and a run of three letters, and none of the bad patterns."""
    ok = (F.size(fx.words(sentence)) >= least_words) & sentence.rlike("[a-zA-Z]{3,}")
    for p in bad:
        ok = ok & ~sentence.rlike(f"(?i){p}")
    return ok


def blocked(url: Column, categories: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    """Whether a URL names a blocked category (blanks and underscores alike) or fits a blocked pattern, in any case."""
    x = F.replace(F.lower(url), F.lit("_"), F.lit(" "))
    hit = F.lit(False)
    for c in categories:
        hit = hit | F.contains(x, F.lit(c.lower().replace("_", " ")))
    return hit | url.rlike(f"(?i){'|'.join(patterns)}") if patterns else hit


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with {name} replaced by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
