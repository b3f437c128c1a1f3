"""TF-IDF, dictionary and rule extraction, token spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from textmill.functions import grams
from textmill.functions import text as fx
from textmill.operators.lineage import cut

#: The bytes with which a term [a-z][a-z0-9/-]* begins and goes on.
LETTERS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
INNER = LETTERS | np.isin(np.arange(256), list(b"0123456789/-"))
#: Patterns of the rule extractors. Group 1 is the entity.
PREFIXED = r"(?:MV|M/V|MT|M/T|SS)\s+([A-Z][A-Za-z-]+(?:\s[A-Z][A-Za-z-]+)?)"
FROM_TO = r"(?i)from\s+([a-z]{3,})\s+to\s+([a-z]{3,})"
QUANTITY = r"(?i)([0-9][0-9.,]*)\s*(?:mts?|tons?|kg|lbs)\s+(?:of\s+)?([a-z]{3,})"
CODES = ("FOB", "CIF", "CFR", "EXW", "FAS", "DAP", "DDP")


#: Grams that are broadcast to find their strings; more are joined.
MOST_GRAMS = 1 << 21


def row_grams(rows: np.ndarray, hashes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, gram, n) of all n-grams of up to ``longest`` tokens."""
    parts = [(*grams.ngrams(rows, hashes, n), n) for n in range(1, longest + 1)]
    return (*(np.concatenate([p[i] for p in parts]) for i in range(3)), np.concatenate([np.full(len(p[0]), p[3]) for p in parts]))


def tfidf(df: DataFrame, text: str = "text", key: str = "doc_id", longest: int = 3, least_df: int = 2, most_df: float = 0.8, features: int = 5000) -> DataFrame:
    """(key, term, weight): smooth idf ln((1 + n) / (1 + df)) + 1, rows of length 1, over the ``features`` terms of the highest corpus count (then by name).

    Keys tell rows apart. Terms are found in the bytes of lower-cased texts, in blocks, and n-grams travel as hashes, added up for each block before they are
    shuffled; strings are looked up for those that may be chosen only. The chosen terms, ``features`` at most, are broadcast, and a row's weights are made
    where the row is, without a shuffle. A worker holds one block and no words.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("__text")
    docs = df.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, data in grams.text_blocks(batches, 0):
            row, start, end = grams.runs(offsets, data, LETTERS, INNER)
            row, _, gram, _ = row_grams(row, grams.word_hashes(data, start, end), longest)
            _, g, n = grams.distinct(row, gram)
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(np.diff(np.append(first, len(g)))), pa.array(np.add.reduceat(n, first))], names=["gram", "df", "cf"])

    stats = df.select(lowered).mapInArrow(count, "gram long, df long, cf long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    known = cut(stats.where((F.col("df") >= least_df) & (F.col("df") <= most_df * docs)))
    top = known.orderBy(F.desc("cf")).limit(features).agg(F.count("*").alias("n"), F.min("cf").alias("least")).first()
    candidates = known.where(F.col("cf") >= (top["least"] if top["n"] == features else 0))
    few = candidates.count() <= MOST_GRAMS
    wanted = df.sparkSession.sparkContext.broadcast(np.sort(candidates.select("gram").toPandas()["gram"].to_numpy(np.int64)) if few else None)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, data in grams.text_blocks(batches, 0):
            row, start, end = grams.runs(offsets, data, LETTERS, INNER)
            _, place, gram, n = row_grams(row, grams.word_hashes(data, start, end), longest)
            if wanted.value is not None:
                own = found(gram, wanted.value) >= 0
                place, gram, n = place[own], gram[own], n[own]
            gram, first = np.unique(gram, return_index=True)
            raw, place, n = data.tobytes(), place[first].tolist(), n[first].tolist()
            said = [b" ".join(raw[start[i] : end[i]] for i in range(p, p + k)).decode() for p, k in zip(place, n)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(said, pa.string())], names=["gram", "term"])

    named = df.select(lowered).mapInArrow(strings, "gram long, term string").groupBy("gram").agg(F.min("term").alias("term"))
    chosen = candidates.join(named, "gram").orderBy(F.desc("cf"), "term").limit(features).toPandas().sort_values("gram")
    idf = np.log((1 + docs) / (1 + chosen["df"].to_numpy(np.float64))) + 1
    shared = df.sparkSession.sparkContext.broadcast((chosen["gram"].to_numpy(np.int64), idf, pa.array(chosen["term"].tolist(), pa.string())))
    schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, share, names = shared.value
        for block, offsets, data in grams.text_blocks(batches, 1):
            row, start, end = grams.runs(offsets, data, LETTERS, INNER)
            row, _, gram, _ = row_grams(row, grams.word_hashes(data, start, end), longest)
            at = found(gram, own)
            r, g, n = grams.distinct(row[at >= 0], at[at >= 0])
            if len(r):
                w = n * share[g]
                w /= np.sqrt(np.bincount(r, w * w))[r]
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(r)), names.take(pa.array(g)), pa.array(w)], names=schema.fieldNames())

    return df.select(F.col(key), lowered).mapInArrow(weigh, schema)


def found(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value among sorted different ones, -1 if it is not there."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def top_terms(weights: DataFrame, key: str = "doc_id", k: int = 100, least: float = 0.1) -> DataFrame:
    """The k heaviest terms of each document, those over ``least``. Only what may stand before one of these is shuffled."""
    order = W.partitionBy(key).orderBy(F.desc(F.round("weight", 6)), "term")
    return weights.where(F.round("weight", 6) >= F.round(F.lit(least), 6)).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("weight") > least))


def dictionary_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur in the lower-cased text, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t))


def extract_distinct(text: Column, pattern: str, group: int) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), lambda x: F.lower(F.trim(x)))))


def code_matches(text: Column, codes: tuple[str, ...] = CODES) -> Column:
    """Codes that stand alone in capitals."""
    return extract_distinct(text, rf"(?:^|[^A-Za-z])({'|'.join(codes)})(?:$|[^A-Za-z])", 1)


def align(tokens: Column, entity: Column) -> Column:
    """Starts (from 0) at which the entity's tokens occur, case aside."""

    def found(low: Column, e: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(low) - F.size(e))
        return F.when((F.size(e) > 0) & (F.size(low) >= F.size(e)), F.filter(places, lambda i: F.slice(low, i + 1, F.size(e)) == e)).otherwise(F.array().cast("array<int>"))

    lowered = F.transform(tokens, F.lower)
    return fx.let(F.transform(fx.ner_tokens(entity), F.lower), lambda e: fx.let(lowered, lambda low: found(low, e)))


def aligned(df: DataFrame, entities: list[tuple[str, str]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, entity, type, start, end): where the tokens of each (entity, type) occur among those of a text, case aside; places count from 0.

    A text is cut in tokens once, for all entities; in a block of texts only different tokens are lower-cased and looked up.
    """
    cased = df.sparkSession.createDataFrame([(e,) for e, _ in entities], "entity string").select("entity", fx.ner_tokens("entity").alias("t"))
    tokens_of = {r["entity"]: [t.lower() for t in r["t"]] for r in cased.collect()}
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("entity string, type string, start long, end long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grams.blocks(batches, 1):
            tokens = block.column(1)
            sizes = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
            row = np.repeat(np.arange(len(tokens)), sizes)
            begin = np.cumsum(sizes) - sizes
            words = tokens.flatten().dictionary_encode()
            code, of = words.indices.to_numpy(), {}
            for i, word in enumerate(words.dictionary.to_pylist()):
                of.setdefault(word.lower(), []).append(i)
            for entity, kind in entities:
                wanted = tokens_of[entity]
                at = np.zeros(0, np.int64)
                if wanted and all(w in of for w in wanted):
                    at = np.flatnonzero(np.isin(code[: max(0, len(code) - len(wanted) + 1)], of[wanted[0]]))
                    for i, w in enumerate(wanted[1:], 1):
                        at = at[np.isin(code[at + i], of[w])]
                    at = at[row[at] == row[at + len(wanted) - 1]]
                if len(at):
                    start = at - begin[row[at]]
                    names = [pa.array([x] * len(at), pa.string()) for x in (entity, kind)]
                    yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row[at])), *names, pa.array(start), pa.array(start + len(wanted) - 1)], names=schema.fieldNames())

    return df.select(F.col(key), fx.ner_tokens(text).alias("__tokens")).mapInArrow(run, schema)


def gap_classes(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of a document's neighbouring spans (start, end) that overlap, are at most 2 or at most 5 tokens apart, weighted 1, 0.7, 0.4."""
    gap = F.lead("start").over(W.partitionBy(key).orderBy("start", "end")) - F.col("end") - 1
    weight = F.when(F.col("gap") <= 0, 1.0).when(F.col("gap") <= 2, 0.7).when(F.col("gap") <= 5, 0.4).otherwise(0.0)
    return spans.withColumn("gap", gap).where("gap is not null").groupBy(key).agg(F.count("*").alias("gaps"), F.avg(weight).alias("overlap_score"))


def common_labels(spans: DataFrame, label: str, least: int) -> DataFrame:
    """Spans whose label occurs at least ``least`` times."""
    return spans.join(spans.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label), label, "left_semi")


def substitute(tokens: Column, spans: Column, entities: Column) -> Column:
    """Tokens and spans after replacing each span (ascending, apart) by the entity of its place: struct(tokens, spans); later spans move along."""
    empty = F.from_json(F.lit('{"tokens":[],"spans":[],"at":0}'), "struct<tokens:array<string>,spans:array<struct<start:int,end:int>>,at:int>")

    def step(state: Column, s: Column) -> Column:
        new = fx.ner_tokens(s["entity"])
        kept = F.concat(state["tokens"], F.slice(tokens, state["at"] + 1, s["start"] - state["at"]))
        span = F.struct(F.size(kept).cast("int").alias("start"), (F.size(kept) + F.size(new) - 1).cast("int").alias("end"))
        return F.struct(F.concat(kept, new).alias("tokens"), F.array_append(state["spans"], span).alias("spans"), (s["end"] + 1).cast("int").alias("at"))

    zipped = F.zip_with(spans, entities, lambda s, e: F.struct(s["start"].alias("start"), s["end"].alias("end"), e.alias("entity")))
    finish = lambda st: F.struct(F.concat(st["tokens"], F.slice(tokens, st["at"] + 1, F.greatest(F.size(tokens) - st["at"], F.lit(0)))).alias("tokens"), st["spans"].alias("spans"))
    return F.aggregate(zipped, empty, step, finish)
