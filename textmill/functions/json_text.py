"""JSON objects in the answers of models, found by matching brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import col, let

#: Escapes, brackets, quotes, and runs of anything else.
PIECES = r"(?s)\\.|[{}\"]|[^\\{}\"]+|\\"
IDEOGRAPHS = "[一-鿿]+"


def first_object(text: Column | str) -> Column:
    """The object that begins at the first {, up to the bracket that closes it; brackets in strings don't count. Null if there is none or it is not closed.

    One fold over the pieces of the text with a state of fixed size, so a long answer takes time in proportion.
    """

    def step(st: Column, piece: Column) -> Column:
        opens, closes = ~st["inside"] & (piece == "{"), ~st["inside"] & (piece == "}")
        depth = st["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        inside = F.when(piece == '"', ~st["inside"]).otherwise(st["inside"])
        moved = F.struct(depth.alias("depth"), inside.alias("inside"), (st["n"] + F.length(piece)).alias("n"), (depth == 0).alias("done"))
        return F.when(st["done"], st).otherwise(moved)

    def found(x: Column) -> Column:
        begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        return F.aggregate(F.regexp_extract_all(x, F.lit(PIECES), F.lit(0)), begin, step, lambda st: F.when(st["done"], F.substring(x, F.lit(1), st["n"])))

    whole = col(text)
    return let(F.when(F.instr(whole, "{") > 0, F.substring(whole, F.instr(whole, "{"), F.length(whole))), found)


def peeled(text: Column | str) -> Column:
    """The trimmed text without the pairs of equal quotes that wrap it, as often as it is wrapped."""
    whole = F.trim(col(text))
    # no more pairs than signs in the run of quotes and blanks at its start
    run = F.length(F.regexp_extract(whole, r"^[\"'\s]*", 0))

    def peel(x: Column) -> Column:
        wrapped = (F.length(x) >= 2) & F.substring(x, 1, 1).isin('"', "'") & (F.substring(x, 1, 1) == F.substring(x, -1, 1))
        return F.when(wrapped, F.trim(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.coalesce(run, F.lit(0))), whole, lambda x, _: peel(x))


def answer_object(text: Column | str) -> Column:
    """The first object of an answer, without quotes around it, thoughts, fences and ideographs; null without one."""
    x = F.regexp_replace(peeled(text), r"(?s)<think>.*?</think>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"```(?:json)?", ""), IDEOGRAPHS, "")
    return first_object(x)
