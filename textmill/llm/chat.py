"""Quotation linking in conversations, in DataFrame functions only.

Lines that start with ``>`` are quoted, at the level that is the number of such signs; consecutive lines of one level are
a passage. Passages are lower-cased, blanks are collapsed, and their hashes are joined, within the conversation, with those of the unquoted
whole texts, paragraphs and lines of messages; the original is the earliest message that holds the passage, if it is
earlier than the quote. A message answers the latest original of its level-one passages. Root and depth in the tree of answers
come by pointer doubling. The reply order of a conversation is by root, then turn: threads one after the other; ``position`` is a message's place in it, found
by ranges of the order, so a long conversation is sorted by many tasks. Texts lose quotes and the lines that announce them.

Defined results: a null text counts as empty; a passage without an original links to nothing; a message that answers nothing is its
own root at depth 0; rows with the same conversation and turn have the same position, nulls come first; a passage whose whole is nowhere is matched by its lines; repeated rows get equal results; rows with
a null conversation or turn link to nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm.shared import cut_lineage

MARKS = r"^(?:[ \t]*>)+"
ANNOUNCES = r"^\s*(?:on .+ wrote|am .+ schrieb.*|le .+ a écrit|el .+ escribió)\s*:\s*$"


def level(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, MARKS, 0), F.lit(">"))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(text: Column) -> Column:
    """(level, lines) of each run of lines of one level, without quote marks."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))

    def runs(ls: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]))

        def cut(at: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                end = F.coalesce(F.get(at, k + 1), F.size(ls))
                return F.struct(F.get(ls, s)["level"].alias("level"), F.transform(F.slice(ls, s + 1, end - s), lambda x: x["line"]).alias("lines"))

            return F.transform(at, one)

        return F.transform(F.array(starts), cut)[0]

    return F.transform(F.array(lines), runs)[0]


def marked(df: DataFrame, text: str) -> DataFrame:
    """df with its passages, and its text without quotes and their announcements."""
    own = F.flatten(F.transform(F.filter("__passages", lambda p: p["level"] == 0), lambda p: p["lines"]))
    quoted = F.exists("__passages", lambda p: p["level"] > 0)
    kept = F.when(quoted, F.filter(own, lambda x: ~F.lower(x).rlike(ANNOUNCES))).otherwise(own)
    return df.withColumn("__passages", passages(F.col(text))).withColumn("clean_text", F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")))


def link_quotes(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row for each quoted passage: conv_id, turn, level, passage_hash, passage, source_turn (null without an original)."""
    base = df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    messages = marked(base, "text")
    whole = F.array(normal(F.col("clean_text")))
    paragraphs = F.transform(F.split("clean_text", r"\n\s*\n"), normal)
    lines = F.transform(F.split("clean_text", "\n"), normal)
    keys = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(whole, paragraphs, lines))).alias("key")).where("key <> ''")
    originals = keys.groupBy("conv_id", F.md5(F.col("key").cast("binary")).alias("hash")).agg(F.min("turn").alias("source"))
    quotes = messages.select("conv_id", "turn", F.explode(F.filter("__passages", lambda p: p["level"] > 0)).alias("p")).distinct()
    quotes = quotes.select("conv_id", "turn", F.col("p.level").cast("long").alias("level"), normal(F.array_join("p.lines", " ")).alias("passage"), F.col("p.lines").alias("lines")).where("passage <> ''")
    quotes = quotes.withColumn("passage_hash", F.md5(F.col("passage").cast("binary")))
    parts = F.array_distinct(F.concat(F.array("passage"), F.transform("lines", normal)))
    looked = quotes.select("conv_id", "turn", "level", "passage_hash", "passage", F.posexplode(parts).alias("part", "key")).where("key <> ''")
    looked = looked.withColumn("hash", F.md5(F.col("key").cast("binary")))
    found = looked.join(originals, ["conv_id", "hash"], "left")
    source = F.when(F.col("source") < F.col("turn"), F.col("source"))
    best = found.groupBy("conv_id", "turn", "level", "passage_hash", "passage").agg(
        F.max(F.when(F.col("part") == 0, source)).alias("by_whole"), F.max(F.when(F.col("part") > 0, source)).alias("by_line")
    )
    return best.select("conv_id", "turn", "level", "passage_hash", "passage", F.coalesce("by_whole", "by_line").alias("source_turn"))


def reply_order(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth for every message of ``links`` (conv_id, turn, parent_turn)."""
    now = cut_lineage(links.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        joined = cut_lineage(now.join(up, ["conv_id", "root_turn"], "left"))
        if joined.where("above is not null").isEmpty():
            return joined.select("conv_id", "turn", "parent_turn", "root_turn", "depth")
        now = joined.select("conv_id", "turn", "parent_turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def placed(df: DataFrame) -> DataFrame:
    """df with position: the place, from 0, of (root_turn, turn) among those of its conv_id."""
    order = ["root_turn", "turn"]
    dealt = cut_lineage(df.repartitionByRange("conv_id", *order).withColumn("__part", F.spark_partition_id()))
    inner = F.dense_rank().over(W.partitionBy("__part", "conv_id").orderBy(*order))
    ranked = dealt.withColumn("__inner", inner.cast("long"))
    # a conversation that lies in several ranges goes on counting; one row for each range and conversation
    sizes = ranked.groupBy("__part", "conv_id").agg(F.max("__inner").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("__part").alias("__p"), F.col("conv_id").alias("__c"), before.alias("__before"))
    joined = ranked.join(starts, (F.col("__part") == F.col("__p")) & F.col("conv_id").eqNullSafe(F.col("__c")))
    return joined.withColumn("position", F.col("__inner") + F.col("__before") - 1).drop("__part", "__inner", "__p", "__c", "__before")


def without_quotes(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ("role",)) -> DataFrame:
    """One row for each message: conv_id, turn, ``keep``, clean_text, n_passages, max_level, n_linked, parent_turn, root_turn, depth, position."""
    quotes = cut_lineage(link_quotes(df, conversation, turn, text))
    linked = quotes.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_passages"), F.max("level").alias("max_level"), F.count("source_turn").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source_turn"))).alias("parent_turn")
    )
    linked = cut_lineage(linked)
    tree = reply_order(linked.where("parent_turn is not null")).drop("parent_turn")
    facts = linked.join(tree, ["conv_id", "turn"], "left")
    # places come from keys and numbers alone; texts move once, to meet them
    keys = df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn")).distinct().join(facts, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_passages", "max_level", "n_linked", "depth")]
    told = placed(keys.select("conv_id", "turn", *counts, "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn")))
    told = told.withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    made = ("conv_id", "turn", "clean_text", "n_passages", "max_level", "n_linked", "parent_turn", "root_turn", "depth", "position")
    others = [c for c in keep if c not in made]
    base = marked(df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), *others, F.col(text).alias("__text")), "__text")
    out = base.join(told, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn")))
    return out.select("conv_id", "turn", *others, *made[2:])


#: The same rows in DuckDB, with its lists and a recursive query.
SQL = r"""
WITH RECURSIVE rows0 AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines0 AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM rows0),
lines AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:[ \t]*>)+', '') AS line FROM lines0),
flags AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) IS DISTINCT FROM level THEN 1 ELSE 0 END AS fresh, max(level) OVER (PARTITION BY id) AS top FROM lines),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run FROM flags),
clean AS (SELECT id, trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (top > 0 AND regexp_matches(lower(line), '^\s*(?:on .+ wrote|am .+ schrieb.*|le .+ a écrit|el .+ escribió)\s*:\s*$'))), ''), '\n{3,}', chr(10) || chr(10), 'g')) AS clean_text FROM runs GROUP BY id),
bodies AS (SELECT r.conv_id, r.turn, c.clean_text FROM rows0 r JOIN clean c USING (id)),
keys0 AS (SELECT conv_id, turn, clean_text AS k FROM bodies UNION SELECT conv_id, turn, unnest(regexp_split_to_array(clean_text, '\n\s*\n')) FROM bodies UNION SELECT conv_id, turn, unnest(string_split(clean_text, chr(10))) FROM bodies),
originals AS (SELECT conv_id, trim(regexp_replace(lower(k), '\s+', ' ', 'g')) AS k, min(turn) AS source FROM keys0 GROUP BY 1, 2),
passages AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '\s+', ' ', 'g')) AS passage, list(trim(regexp_replace(lower(line), '\s+', ' ', 'g')) ORDER BY i) AS ls FROM runs WHERE level > 0 GROUP BY id, conv_id, turn, run, level),
parts AS (SELECT conv_id, turn, level, passage, passage AS k, 0 AS part FROM passages UNION SELECT conv_id, turn, level, passage, unnest(ls), 1 FROM passages),
found AS (SELECT p.conv_id, p.turn, p.level, p.passage, coalesce(max(o.source) FILTER (WHERE p.part = 0), max(o.source) FILTER (WHERE p.part = 1 AND p.k <> p.passage)) AS source_turn FROM parts p LEFT JOIN originals o ON o.conv_id = p.conv_id AND o.k = p.k AND p.k <> '' AND o.source < p.turn WHERE p.passage <> '' GROUP BY 1, 2, 3, 4),
linked AS (SELECT conv_id, turn, count(*) AS n_passages, max(level) AS max_level, count(source_turn) AS n_linked, max(source_turn) FILTER (WHERE level = 1) AS parent_turn FROM found GROUP BY 1, 2),
tree AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM linked WHERE parent_turn IS NOT NULL UNION ALL SELECT t.conv_id, t.turn, l.parent_turn, t.depth + 1 FROM tree t JOIN linked l ON l.conv_id = t.conv_id AND l.turn = t.root_turn WHERE l.parent_turn IS NOT NULL),
roots AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM tree GROUP BY 1, 2)
SELECT r.conv_id, r.turn, r.role, c.clean_text, coalesce(l.n_passages, 0)::BIGINT AS n_passages, coalesce(l.max_level, 0)::BIGINT AS max_level, coalesce(l.n_linked, 0)::BIGINT AS n_linked, l.parent_turn, coalesce(t.root_turn, r.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth,
 dense_rank() OVER (PARTITION BY r.conv_id ORDER BY coalesce(t.root_turn, r.turn) NULLS FIRST, r.turn NULLS FIRST) - 1 AS position
FROM rows0 r JOIN clean c USING (id) LEFT JOIN linked l ON l.conv_id = r.conv_id AND l.turn = r.turn LEFT JOIN roots t ON t.conv_id = r.conv_id AND t.turn = r.turn
"""
