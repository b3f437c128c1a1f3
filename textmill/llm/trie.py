"""Prefix trie of conversations, level by level, as succinct tries of shards.

A node is a distinct sequence of first turns. Its key is a sum, modulo 2^64 in two lanes, of scrambled digests of (depth, role,
text), so running sums along conversations give the keys; texts are read once and never shuffled. Rows are dealt out by ranges of
(conversation, place), so a conversation may span many tasks; each task adds what earlier ones hold of its first conversation.

Nodes come from one aggregation by key. What follows depends on a node's members:

* one member: the rest of a conversation is a path, whose figures are known; only its top goes on to a trie.
* more members, and at most ``shard_rows`` turns below them: the node lies in a prefix shard, that of its topmost such ancestor. Shards
  are dealt out by key. For a block of them numpy writes the nodes in level order as a LOUDS bitvector (a one for each child, then
  a zero) with an array of labels; select gives each node's parent, and np.add.at over the levels, deepest first, the rollups.
* more members, and more turns below: an upper node. Figures of shards and paths are summed by the upper node above them, and
  the upper nodes are merged by the same tries, in bands of depths of at most ``most_upper`` nodes each (one band, as a rule; a
  level is never cut, and holds at most one node for each ``shard_rows`` turns of the table).

The hash of a node's ending members is fed in order from chunks of CHUNK ids, as SHA-256 is sequential; no list of ids is held whole.

Defined results: null roles and texts are empty; rows of a null conversation belong to none and are left out; null turns come first, and rows
that share a conversation and a turn are in the order of their digests; a conversation may be rebuilt to no turn at all and then ends at the root; a turn of any length is a label of
fixed size; an empty table has no node, not even a root; other columns are left out, so none can clash. Keys have 120 random
bits: among 10^12 different sequences some two are taken for one with a probability under 10^-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.fim import RankSelect
from textmill.llm.shared import cut_lineage, mix64

#: First turns that a conversation may take from the one that ends its hundred, turns under the root of a shard, upper nodes of a band.
HEADS, SHARD_ROWS, MOST_UPPER = 6, 1 << 16, 1 << 20
#: Nodes of a block of shards, ids of a chunk that is hashed, rows of a batch, depths of a step of a path.
BLOCK, CHUNK, BATCH, STEP = 1 << 17, 256, 1 << 14, 1 << 12
KEY, PARENT = ("k1", "k2"), ("p1", "p2")
#: The hash of no member.
NOTHING = hashlib.sha256(b"").hexdigest()


def columns(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, dict[str, np.ndarray]]:
    """All rows of a task, whose number is bounded as ranges or blocks are."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None, {}
    table = pa.Table.from_batches(held)
    return table, {c: table[c].to_numpy() for c in table.column_names if table[c].null_count == 0 and not pa.types.is_string(table[c].type)}


def batches_of(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    table = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
    yield from table.to_batches(max_chunksize=BATCH)


def by_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt out by ranges of the order and sorted within them, as written: its partitions stay what they are."""
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))


def runs(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one conversation begin, and the run of each row."""
    new = np.append(True, conv[1:] != conv[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def summary(dealt: DataFrame, extra: Callable[[int, dict[str, np.ndarray]], list[int]] | None = None, names: tuple[str, ...] = ()) -> dict[int, list[int]]:
    """Of each partition with rows: its first and last conversation, how many rows it has of each, and what ``extra`` adds. A row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = columns(batches)
        if x:
            part, conv = TaskContext.get().partitionId(), x["conv"]
            row = [part, conv[0], conv[-1], int((conv == conv[0]).sum()), int((conv == conv[-1]).sum())]
            yield from batches_of({n: np.array([v], np.int64) for n, v in zip(fields, row + (extra(part, x) if extra else []))})

    fields = ["part", "first", "last", "n_first", "n_last", *names]
    return {r.part: list(r)[1:] for r in dealt.mapInArrow(run, ", ".join(f"{n} long" for n in fields)).collect()}


def offsets(parts: dict[int, list[int]]) -> tuple[dict[int, int], dict[int, int]]:
    """Of each partition: rows of its first conversation in earlier ones, rows of its last one in later ones."""
    before, after = {}, {}
    for found, ids, own, far, n_own in ((before, sorted(parts), 0, 1, 3), (after, sorted(parts, reverse=True), 1, 0, 2)):
        conv, count = None, 0
        for p in ids:
            row = parts[p]
            found[p] = count if row[own] == conv else 0
            count = row[n_own] + (found[p] if row[own] == row[far] else 0)
            conv = row[far]
    return before, after


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, d1, d2, chars): the place of each row in its conversation, from 1, with the digest of role and text."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digits = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    lanes = [F.conv(F.substring(digits, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"d{i + 1}") for i in (0, 1)]
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), *lanes, F.length(said).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    dealt = by_ranges(cut_lineage(rows), ["conv", "turn", "d1", "d2", "row"]).select("conv", "d1", "d2", "chars")
    before, _ = offsets(summary(dealt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = columns(batches)
        if x:
            starts, of = runs(x["conv"])
            pos = np.arange(len(of)) - starts[of] + 1
            pos[of == 0] += before[TaskContext.get().partitionId()]
            yield from batches_of({"conv": x["conv"], "pos": pos, "d1": x["d1"], "d2": x["d2"], "chars": x["chars"]})

    return cut_lineage(dealt.mapInArrow(run, "conv long, pos long, d1 long, d2 long, chars long"))


def rebuilt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", heads: int = HEADS, every: int = 100) -> DataFrame:
    """The conversations, their first h turns replaced by those of the one that begins their ``every``: a row a turn, and one of depth 0.

    h is the unsigned crc32 of the decimal id, modulo ``heads``. Columns: conv, depth, the key (k1, k2) of the sequence up to this turn, that of
    the one before (p1, p2), chars, rest (turns that follow).
    """
    rows = numbered(df, conv, turn, role, text)
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    first = rows.where((F.col("conv") % every == 0) & (F.col("pos") < heads))
    given = first.groupBy(F.col("conv").alias("base")).agg(F.collect_list(F.struct("pos", "d1", "d2", "chars")).alias("heads"))
    convs = rows.where("pos = 1").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), taken.alias("h"))
    lent = convs.where("h > 0").join(given, "base").select("conv", F.inline(F.filter("heads", lambda x: x["pos"] <= F.col("h"))))
    zero = F.lit(0).cast("long")
    begun = convs.select("conv", zero.alias("pos"), zero.alias("d1"), zero.alias("d2"), zero.alias("chars"))
    return keyed(rows.where(F.col("pos") > taken).unionByName(lent).unionByName(begun))


def keyed(rows: DataFrame) -> DataFrame:
    """Depths and keys of rows (conv, pos, d1, d2, chars), by their order of pos; the first row of each conversation stands for no turn."""
    dealt = by_ranges(rows, ["conv", "pos"])
    parts = summary(dealt)
    before, after = offsets(parts)

    def labels(part: int, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        starts, of = runs(x["conv"])
        depth = np.arange(len(of)) - starts[of]
        depth[of == 0] += before[part]
        odd = np.uint64(0x9E3779B97F4A7C15)
        made = [mix64(x[d].astype(np.uint64) * np.uint64(16) + np.uint64(i) + odd * depth.astype(np.uint64)) for i, d in enumerate(("d1", "d2"))]
        return starts, of, depth, [np.where(depth > 0, m, np.uint64(0)) for m in made]

    def sums(part: int, x: dict[str, np.ndarray]) -> list[int]:
        starts, _, _, made = labels(part, x)
        return [int(m[starts[-1] :].sum(dtype=np.uint64).view(np.int64)) for m in made]

    carried, held = {}, [0, 0]
    totals = summary(dealt, sums, ("s1", "s2"))
    for p in sorted(totals):
        first, last, *_, s1, s2 = totals[p]
        carried[p] = held if before[p] else [0, 0]
        held = [(a + s) % (1 << 64) for a, s in zip(carried[p] if first == last else [0, 0], (s1, s2))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = columns(batches)
        if not x:
            return
        part = TaskContext.get().partitionId()
        starts, of, depth, made = labels(part, x)
        total = np.diff(np.append(starts, len(of)))
        total[0] += before[part]
        total[-1] += after[part]
        out = {"conv": x["conv"], "depth": depth}
        for i, m in enumerate(made):
            total_so_far = np.cumsum(m, dtype=np.uint64)
            key = total_so_far - (total_so_far - m)[starts][of]
            key[of == 0] += np.uint64(carried[part][i])
            out |= {KEY[i]: key.view(np.int64), PARENT[i]: (key - m).view(np.int64)}
        yield from batches_of({n: out[n] for n in ("conv", "depth", *KEY, *PARENT)} | {"chars": x["chars"], "rest": total[of] - 1 - depth})

    return cut_lineage(dealt.mapInArrow(run, "conv long, depth long, k1 long, k2 long, p1 long, p2 long, chars long, rest long"))


class Louds:
    """A forest in level order: ones for children, a zero after each node's, labels beside them; trees hang under one textless top."""

    def __init__(self, level: np.ndarray, key: np.ndarray, parent: np.ndarray) -> None:
        n = len(level)
        both = np.concatenate([key, parent])
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.append(False, (both[order][1:] != both[order][:-1]).any(1))
        name = np.empty(2 * n, np.int64)
        name[order] = np.cumsum(new)
        holder = np.full(2 * n, -1)
        holder[name[:n]] = np.arange(n)
        above = np.where(level > 0, holder[name[n:]], -1)
        by_level = np.argsort(level, kind="stable")
        self.ends = np.cumsum(np.bincount(level))
        place, self.order, start = np.full(n + 1, -1), np.empty(n, np.int64), 0
        for end in self.ends.tolist():
            at = by_level[start:end]
            at = at[np.lexsort((key[at, 1], key[at, 0], place[above[at]]))]
            self.order[start:end], place[at] = at, np.arange(start, end)
            start = end
        self.labels = key[self.order]
        children = np.bincount(place[above[self.order]] + 1, minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(children) + np.arange(n + 1)] = False
        self.bits = RankSelect(bits)
        self.children = children[1:]

    def parents(self) -> np.ndarray:
        """The place of each node's parent in level order; -1 under the top: the zeros before a node's one, less that of the top."""
        node = np.arange(len(self.labels))
        return self.bits.select(node) - node - 1

    def rollup(self, *values: np.ndarray) -> None:
        """Adds to each node what its subtree holds; values are in level order."""
        up = self.parents()
        for low, high in zip(self.ends[-2::-1].tolist(), self.ends[:0:-1].tolist()):
            for v in values:
                np.add.at(v, up[low:high], v[low:high])


FIGURES = "conv long, depth long, k1 long, k2 long, p1 long, p2 long, parent_conv long, n long, last long, n_children long, n_leaves long, saved long, top boolean"


def solved(x: dict[str, np.ndarray], level: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """FIGURES of a forest: own figures of its nodes, and those of what already hangs below them (more_children, more_leaves, more_saved)."""
    key, parent = (np.stack([x[c] for c in names], 1) for names in (KEY, PARENT))
    trie = Louds(level, key, parent)
    x = {c: v[trie.order] for c, v in x.items()}
    n_children = trie.children + x["more_children"]
    leaves = x["more_leaves"] + (n_children == 0)
    saved = x["more_saved"] + (x["n"] - 1) * x["chars"]
    trie.rollup(leaves, saved)
    up = trie.parents()
    owner = pa.array(x["conv"][up], pa.int64(), mask=up < 0)
    own = {c: x[c] for c in ("conv", "depth", *KEY, *PARENT)}
    return own | {"parent_conv": owner, "n": x["n"], "last": x["last"], "n_children": n_children, "n_leaves": leaves, "saved": saved, "top": up < 0}


def shard_figures(pieces: DataFrame) -> DataFrame:
    """FIGURES of nodes that carry their shard (s1, s2): blocks of whole shards become one succinct forest each."""

    def forest(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x = {c: table[c].to_numpy() for c in table.column_names}
        new = np.append(True, (x["s1"][1:] != x["s1"][:-1]) | (x["s2"][1:] != x["s2"][:-1]))
        none = np.zeros(len(new), np.int64)
        x |= {"more_children": none, "more_leaves": none, "more_saved": none}
        yield from batches_of(solved(x, x["depth"] - x["depth"][np.flatnonzero(new)][np.cumsum(new) - 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                table = pa.Table.from_batches(held)
                a, b = table["s1"].to_numpy(), table["s2"].to_numpy()
                whole = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if (a[0], b[0]) != (a[-1], b[-1]) else 0
                if whole:
                    yield from forest(table.slice(0, whole))
                    held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield from forest(pa.Table.from_batches(held))

    dealt = pieces.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "depth")
    return dealt.mapInArrow(run, FIGURES)


def upper_figures(upper: DataFrame, below: DataFrame, most: int) -> DataFrame:
    """FIGURES of the upper nodes; ``below`` has, for a node, figures of what hangs there. Bands of depths, the deepest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = columns(batches)
        if x:
            yield from batches_of(solved(x, x["depth"] - x["depth"].min()))

    step = max(1, (upper.agg(F.max("depth")).first()[0] or 0) // 100_000)
    cells = upper.groupBy((F.col("depth") / step).cast("long").alias("cell")).count().orderBy("cell").collect()
    bands, held = [], 0
    for r in cells:
        if not bands or held + r["count"] > most:
            bands.append([r.cell * step, 0])
            held = 0
        held += r["count"]
        bands[-1][1] = (r.cell + 1) * step
    out = None
    for low, high in reversed(bands or [[0, 1]]):
        hung = below.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("more_children", "more_leaves", "more_saved")])
        band = upper.where((F.col("depth") >= low) & (F.col("depth") < high)).join(hung, [*KEY], "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
        done = cut_lineage(band.repartition(1).mapInArrow(run, FIGURES))
        out = done if out is None else out.unionByName(done)
        below = below.unionByName(hanging(done.where("top")))
    return out


def hanging(tops: DataFrame) -> DataFrame:
    """What tops add to the nodes above them."""
    return tops.select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved").alias("more_saved")
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, digest): SHA-256 of the ascending ids of each key, comma-joined."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = columns(batches)
        if not x:
            return
        new = np.append(True, (x["k1"][1:] != x["k1"][:-1]) | (x["k2"][1:] != x["k2"][:-1]))
        starts = np.flatnonzero(new)
        within = np.arange(len(new)) - starts[np.cumsum(new) - 1]
        at = np.flatnonzero(within % CHUNK == 0)
        ids = x["conv"].astype(str).tolist()
        said = [",".join(ids[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)])]
        yield from batches_of({"k1": x["k1"][at], "k2": x["k2"][at], "first": x["conv"][at], "ids": pa.array(said, pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) != key:
                    out += [(*key, state.hexdigest())] if key else []
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "digest"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["k1", "k2", "digest"])

    order = [*KEY, "conv"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "k1 long, k2 long, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "k1 long, k2 long, digest string")


def tails(stubs: DataFrame) -> DataFrame:
    """The nodes of paths of one member each, from their tops (conv, depth, last, parent_conv)."""
    begun = F.explode(F.sequence("depth", "last", F.lit(STEP).cast("long")))
    steps = stubs.select("conv", "depth", "last", "parent_conv", begun.alias("at"))
    rows = steps.select("conv", "depth", "last", "parent_conv", F.explode(F.sequence("at", F.least("last", F.col("at") + STEP - 1))).alias("at"))
    over = F.col("at") == F.col("last")
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(over, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(over, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def nodes(rows: DataFrame, shard_rows: int = SHARD_ROWS, most_upper: int = MOST_UPPER) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``rows`` are those of ``rebuilt``."""
    firsts = [F.min(c).alias(c) for c in ("depth", *PARENT, "chars")]
    made = rows.groupBy(*KEY).agg(F.min("conv").alias("conv"), *firsts, F.count("*").alias("n"), F.sum("rest").alias("weight"), F.sum(ended().cast("long")).alias("n_ends"))
    every = cut_lineage(made.select("conv", "depth", *KEY, *PARENT, "chars", "n", "weight", "n_ends", F.lit(0).cast("long").alias("last")))
    upper = every.where((F.col("depth") == 0) | (F.col("n") > 1) & (F.col("weight") > shard_rows)).drop("weight")
    light = every.where((F.col("depth") > 0) & (F.col("n") > 1) & (F.col("weight") <= shard_rows)).drop("weight", "n_ends")
    single = every.where((F.col("depth") > 0) & (F.col("n") == 1))
    stubs = single.groupBy("conv").agg(F.min(F.struct("depth", *KEY, *PARENT)).alias("s"), F.max("depth").alias("last"))
    stubs = stubs.select("conv", "s.*", F.lit(0).cast("long").alias("chars"), F.lit(1).cast("long").alias("n"), "last")

    few = upper.count() <= most_upper
    owners = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("owner"))
    owners = F.broadcast(owners) if few else owners
    roots = light.join(owners, [*PARENT], "left_semi").select(*KEY)
    shard_of = rows.join(roots, [*KEY], "left_semi").select("conv", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    placed = cut_lineage(light.unionByName(stubs).join(shard_of, "conv", "left"))
    low = cut_lineage(shard_figures(placed.where("s1 is not null")))
    bare = placed.where("s1 is null").withColumns({"parent_conv": F.lit(None).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")})
    below = hanging(low.where("top")).unionByName(hanging(bare))
    high = upper_figures(upper.drop("n_ends"), below, most_upper)

    path = ["conv", "depth", "last", *PARENT, "parent_conv"]
    tops = low.where("n = 1").select(*path).unionByName(bare.select(*path))
    shared = low.where("n > 1").unionByName(high)
    hashed = every.where("n_ends > 0 and (n > 1 or depth = 0)").select(*KEY)
    digests = end_hashes(rows.where(ended()).join(hashed, [*KEY], "left_semi"))
    own = lambda df: df.join(owners, [*PARENT], "left").withColumn("parent_conv", F.coalesce("parent_conv", F.when(F.col("depth") > 0, F.col("owner"))))
    full = own(shared).join(digests, [*KEY], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return full.unionByName(tails(own(tops)))


def ended() -> Column:
    return F.col("rest") == 0


SQL = r"""
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null),
convs as (
    select conv_id, conv_id - conv_id % 100 as base,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) % 6 as h
    from (select distinct conv_id from t)),
parts as (
    select c.conv_id, 0 as own, pos, role, text from convs c join t on t.conv_id = c.base and pos <= h
    union all
    select conv_id, 1, pos, role, text from t join convs using (conv_id) where pos > h),
m as (
    select conv_id, 0 as depth, '' as key, null as up, 0 as chars from convs
    union all
    select conv_id, depth, array_to_string(said, ','), array_to_string(said[:-2], ','), chars
    from (select conv_id, length(text) as chars, row_number() over w as depth, list(sha256(length(role) || ':' || role || text)) over w as said
        from parts window w as (partition by conv_id order by own, pos rows unbounded preceding))),
lens as (select conv_id, max(depth) as last from m group by conv_id),
nodes as (
    select key, any_value(depth) as depth, any_value(up) as up, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n,
        coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = last), '') as ends
    from m join lens using (conv_id) group by key),
below as (select up as key, count(*) as children from nodes where up is not null group by up),
own as (select nodes.*, coalesce(children, 0) as children from nodes left join below using (key)),
subs as (
    select m.key, sum(case when o.children = 0 then 1 else 0 end) as leaves, sum((o.n - 1) * o.chars) as saved
    from own o join m on m.conv_id = o.conv_id and m.depth <= o.depth group by m.key)
select o.conv_id, o.depth, p.conv_id as parent_conv_id, o.n as n_convs, o.children as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens,
    sha256(o.ends) as ends_sha256
from own o join subs using (key) left join own p on p.key = o.up
"""
