"""Mail chains and model answers: flattening, splitting, joining, positional matching, JSON cleaning, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions.cleaning import json_object_text
from textmill.functions.text import collapse_blanks

#: Fixed value: what stands before each mail of a printed chain.
MARK = r"(?:<)?Email\s*\d+(?:>)?:\s*"


def flatten_chain(df: DataFrame, chain: str, field: str, scope: str = "all") -> DataFrame:
    """One row for each mail of an array of structs whose field is not blank; scope "first" takes the first mail only."""
    mails = F.col(chain) if scope == "all" else F.slice(F.coalesce(F.col(chain), F.array()), 1, 1)
    others = [c for c in df.columns if c != chain]
    return df.select(*others, F.posexplode(mails).alias("position", "mail")).select(*others, "position", F.col(f"mail.{field}").alias(field)).where(F.trim(field) != "")


def concat_turns(df: DataFrame, chain: str, order: str, text: str, joiner: str = "\n\n") -> DataFrame:
    """(chain, n, text): the texts of each chain joined in order. A chain is one document by nature, and its rows meet in one array."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    return df.groupBy(chain).agg(parts.alias("p")).select(chain, F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x["t"]), joiner).alias("text"))


def split_chain(text: Column, mark: str = MARK) -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda part: F.trim(part)), lambda x: x != "")


def format_chain(chain: Column, fields: tuple[str, ...] = ("from", "to", "subject", "timestamp", "body")) -> Column:
    """Blocks of "Field: value", missing values as N/A."""
    block = lambda m: F.concat_ws("\n", *[F.concat(F.lit(f"{f.title()}: "), F.coalesce(m[f], F.lit("N/A"))) for f in fields])
    return F.array_join(F.transform(chain, block), "\n\n---\n\n")


def bodies(text: Column) -> Column:
    """What follows Body: in each block between --- lines, on one line."""
    return F.filter(F.transform(F.split(text, r"-{3,}"), lambda b: collapse_blanks(F.regexp_extract(b, r"(?s)Body:(.*)", 1))), lambda x: x != "")


def positional(left: DataFrame, right: DataFrame, by: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides with the same place in their group; the longer side's rest goes."""
    number = lambda df, order: df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [*by, "place"])


def parse_answer(text: Column, schema: str) -> Column:
    """The JSON object in a model's answer; null if it does not parse."""
    return F.from_json(json_object_text(text), schema)


def answer_fields(text: Column, keys: tuple[str, ...]) -> Column:
    """struct of the keys from the JSON object or else from the last ``key: value`` line."""
    body = json_object_text(text)
    value = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}"), F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf'(?im)^\W*{k}\W*:\s*"?([^",\n]*)'), F.lit(1)), F.lit(-1))), F.lit("")))
    return F.struct(*[value(k).alias(k) for k in keys])


def appended_entities(code: Column) -> Column:
    """(text, type) of every entities.append({...}) of a code answer."""
    calls = F.regexp_extract_all(code, F.lit(r"entities\.append\(\{([^}]*)\}\)"), F.lit(1))
    pick = lambda c, k: F.regexp_extract(c, rf'"{k}"\s*:\s*"([^"]*)"', 1)
    return F.filter(F.transform(calls, lambda c: F.struct(pick(c, "text").alias("text"), pick(c, "type").alias("type"))), lambda e: e["text"] != "")


def ledger(active: DataFrame, finished: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Jobs still active, and those that have finished, with their output."""
    return active.join(finished.select(key), key, "left_anti"), active.join(finished, key)


def requests(df: DataFrame, id_column: str, prompt: str, model: str, tokens: int = 1024) -> DataFrame:
    """One JSON request a row, as a column value."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")))
    body = F.struct(F.lit(model).alias("model"), F.lit(tokens).alias("max_tokens"), message.alias("messages"))
    return df.select(F.to_json(F.struct(F.col(id_column).cast("string").alias("custom_id"), body.alias("params"))).alias("value"))


def results(lines: DataFrame, column: str = "value") -> DataFrame:
    """custom_id and content of JSON response lines; a content that is a JSON list gives one row an element."""
    content = F.coalesce(F.get_json_object(column, "$.response.body.choices[0].message.content"), F.get_json_object(column, "$.choices[0].message.content"), F.get_json_object(column, "$.content"))
    made = lines.select(F.get_json_object(column, "$.custom_id").alias("custom_id"), content.alias("content")).where("content is not null")
    many = F.when(F.trim("content").startswith("["), F.coalesce(F.from_json("content", "array<string>"), F.array("content"))).otherwise(F.array("content"))
    return made.select("custom_id", F.posexplode(many).alias("position", "content"))
