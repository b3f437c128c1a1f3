"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds the distinct five-word shingles of its lower-cased text. The sketch has C coordinates: round i
throws every shingle into a bin by a fresh hash and keeps the least (round, value) of each bin; after C such rounds,
round C + j throws all shingles into bin j, so every coordinate fills. Coordinates agree with the probability of the
Jaccard similarity, concentrated at least as well as independent ones. Bands of coordinates give buckets; their number
and width follow from the similarity asked for: such a pair misses all of them with a probability of MISS at most (0.85: 32
bands of 6; 0.80: 50 of 6).

No bucket is expanded into all its pairs. Equal sets are one node from the start. Round one compares the members of each
bucket with three centres (the same ones in all buckets of a group); components of the verified links are contracted; a
bucket whose members are all in one component is done. The rest go on with new centres while their pairs of members of
different components are many and become fewer, and then exactly those pairs are compared. So each pair that shares a bucket is
either compared or already joined; a large bucket is compared by pairs of blocks of BLOCK members, spread over tasks. Components come from contraction into least neighbours with
pointer jumping, in a number of rounds that grows with the logarithm of their size. A pair is lost only if it shares no band or its sketches agree too little. Before
texts move, pairs must agree in sizes, in three bits of
256 coordinates (a bound that a pair of the similarity asked for misses with probability 1e-8), and in a parity map: bit i tells whether an odd number of
shingles hash to i, so two maps differ in at most as many bits as the sets differ in shingles; this rejects no true pair.

Defined results: texts without words (or null) have no shingles and link with nothing; rows with a null key link with nothing, are
kept and have a null component; rows that share a key count as one document, whose text for the exact comparison is the least of theirs; repeated rows are in one component;
columns of the input beside key and text don't matter; an empty table gives no rows. Lost executors: each round starts from checkpointed tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import cut_lineage, map_text, mix64, text_blocks, utf8

WORDS = 5
PERCENT = 85
#: Bands use so many coordinates at most; probabilities that a similar enough pair shares no band, and that its sketches agree too little.
MOST_COORDS = 320
MISS = 3e-7
SIGN_MISS = 1e-8
#: Three bits of each of the first 256 coordinates, as longs.
SIGN = 256
PLANES = 3
WORDS64 = SIGN // 64
SIGN_COLUMNS = tuple(f"w{i}" for i in range(PLANES * WORDS64))
#: Bits of the parity map, as longs.
PARITY = 512
PARITY_COLUMNS = tuple(f"p{i}" for i in range(PARITY // 64))
FACTS = SIGN_COLUMNS + PARITY_COLUMNS
#: Nodes whose ids may be broadcast as a filter of the scan; beyond it the filter is a shuffle join.
BROADCAST_NODES = 1_000_000
CENTRE_SEEDS = (11, 12)
#: Members of a bucket that are compared with each other in one task.
BLOCK = 4096
MORE_ROUNDS = 3
MANY = 4096
_rng = np.random.Generator(np.random.PCG64(20240521))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, np.uint64)
BYTE_CODE[65:91] = BYTE_CODE[97:123]  # A-Z count as a-z
PLACE = _rng.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)
SEEDS = _rng.integers(1, 1 << 63, 2 * MOST_COORDS, np.uint64)
_powers = np.ones(1, np.uint64)


@lru_cache
def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): bands of the most rows, six at most, that miss a pair of the similarity with probability MISS at most."""
    for rows in range(6, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-min(percent / 100, 0.99) ** rows)) if percent > 0 else MOST_COORDS + 1
        if rows * bands <= MOST_COORDS:
            return rows, bands
    raise ValueError(f"a similarity of {percent} percent is too low for {MOST_COORDS} coordinates")


@lru_cache
def sign_agree(percent: int) -> int:
    """So many of SIGN coordinates agree in PLANES bits, but with probability SIGN_MISS, at the similarity."""
    p = min(percent / 100, 0.99)
    p += (1 - p) / 2**PLANES
    below = 0.0
    for k in range(SIGN):
        below += math.comb(SIGN, k) * p**k * (1 - p) ** (SIGN - k)
        if below > SIGN_MISS:
            return k
    return SIGN


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd constant modulo 2**64."""
    global _powers
    if len(_powers) < n:
        base = np.full(1 << int(n).bit_length(), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _powers = np.cumprod(base)
    return _powers


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and where each text's begin."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[1:] &= space[:-1]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    texts = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    place = np.flatnonzero(inside)
    word_at = np.searchsorted(place, start)
    size = np.diff(np.append(word_at, len(place)))
    nth = np.arange(len(place)) - np.repeat(word_at, size)
    word = mix64(np.add.reduceat(BYTE_CODE[data[place]] * powers(int(size.max()))[nth], word_at) + size.astype(np.uint64))
    begins = np.searchsorted(start, offsets)
    count = np.diff(begins)
    wide = np.concatenate([word, np.zeros(WORDS - 1, np.uint64)])
    shingle = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        shingle += mix64(wide[k : k + len(word)] ^ PLACE[k]) * PLACE[k]
    shingle = mix64(shingle)
    doc = np.repeat(np.arange(texts), count)
    good = np.arange(len(word)) + WORDS <= begins[1:][doc]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        at = begins[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            has = k < count[short]
            whole[has] += mix64(word[at[has] + k] ^ PLACE[k]) * PLACE[k]
        shingle[at] = mix64(whole + count[short].astype(np.uint64))
        good[at] = True
    shingle, doc = shingle[good], doc[good]
    begin = np.searchsorted(doc, np.arange(texts + 1))
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a > 1:
            shingle[a:b].sort()
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    shingle, doc = shingle[new], doc[new]
    return shingle, np.searchsorted(doc, np.arange(texts + 1))


def sketches(sets: np.ndarray, begin: np.ndarray, coords: int) -> np.ndarray:
    """texts x coords; rows of texts without shingles stay at the maximum."""
    texts = len(begin) - 1
    empty = np.uint64((1 << 64) - 1)
    out = np.full((texts, coords), empty, np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(texts), np.diff(begin))
    x = sets
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * coords):
        if not len(x):
            break
        h = mix64(x ^ SEEDS[i])
        if i < coords:
            bins = ((h >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(x), i - coords)
        np.minimum.at(flat, doc * coords + bins, (np.uint64(i) << np.uint64(48)) | (h & low))
        open_doc = (out == empty).any(1)
        stay = open_doc[doc]
        if not stay.all():
            x, doc = x[stay], doc[stay]
    return out


def parity_maps(sets: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """PARITY_COLUMNS of each text."""
    texts = len(begin) - 1
    at = np.repeat(np.arange(texts), np.diff(begin)) * PARITY + (mix64(sets ^ np.uint64(0x51F15EED)) >> np.uint64(40)).astype(np.int64) % PARITY
    odd = (np.bincount(at, minlength=texts * PARITY) & 1).astype(np.uint8).reshape(texts, PARITY)
    words = np.packbits(odd, axis=1).view(np.int64)
    return [words[:, i].copy() for i in range(len(PARITY_COLUMNS))]


def sketch_documents(df: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """key, n_shingles, two hashes of the set, the keys of its bands and FACTS."""

    rows, bands_of = banding(percent)

    def make():
        band = (np.arange(bands_of, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        weight = SEEDS[:rows] | np.uint64(1)

        def block(column: pa.Array) -> list:
            sets, begin = shingle_sets(*utf8(column))
            texts, n = len(column), np.diff(begin)
            sk = sketches(sets, begin, max(SIGN, rows * bands_of))
            keys = mix64((mix64(sk[:, : rows * bands_of]).reshape(texts, bands_of, rows) * weight).sum(2, dtype=np.uint64) + band)
            low = (mix64(sk[:, :SIGN]) & np.uint64(255)).astype(np.uint8)
            sign = [np.packbits((low >> p) & 1, axis=1).reshape(texts, WORDS64, 8).view(np.int64)[:, w, 0].copy() for p in range(PLANES) for w in range(WORDS64)]
            hashes = []
            for seed in (0x1234567, 0x7654321):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(seed)))])
                hashes.append(mix64(total[begin[1:]] - total[begin[:-1]] + n.astype(np.uint64)).view(np.int64))
            some = n > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands_of, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1).view(np.int64)))
            return [n.astype(np.int64), *hashes, bands, *sign, *parity_maps(sets, begin)]

        return block

    return map_text(df, make, "n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{c} long" for c in FACTS), text, [key])


def set_bytes(df: DataFrame, text: str, key: str) -> DataFrame:
    """key and its shingle hashes, ascending, as bytes."""

    def make():
        def block(column: pa.Array) -> list:
            sets, begin = shingle_sets(*utf8(column))
            return [pa.array([sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())]

        return block

    return map_text(df, make, "shingles binary", text, [key])


def told(facts: DataFrame, side: str) -> DataFrame:
    """facts with its columns but bucket named for one side of a pair."""
    return facts.select(*[F.col(c) if c == "bucket" else F.col(c).alias(f"{c}_{side}") for c in facts.columns])


def likely(percent: int) -> Column:
    """Whether sizes and sketches of sides x and y allow the similarity."""
    sizes = F.least("n_shingles_x", "n_shingles_y") * 100 >= F.greatest("n_shingles_x", "n_shingles_y") * percent
    apart = F.lit(0)
    for w in range(WORDS64):
        bits = F.lit(0).cast("long")
        for p in range(PLANES):
            c = SIGN_COLUMNS[p * WORDS64 + w]
            bits = bits.bitwiseOR(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y")))
        apart = apart + F.bit_count(bits)
    differ = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in PARITY_COLUMNS), F.lit(0))
    same = differ * (100 + percent) <= (F.col("n_shingles_x") + F.col("n_shingles_y")) * (100 - percent)
    return sizes & (SIGN - apart >= sign_agree(percent)) & same


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets (xa, xb) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_blocks(iter([whole]), 3):
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, pairs.select("a", "b").schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def jumped(into: DataFrame) -> tuple[DataFrame, int]:
    """(node, to) with every node pointing at its root, and the number of rounds; every ``to`` is also a node, and roots point at themselves."""
    rounds = 0
    while True:
        # only nodes that others point at, and that are no roots, have to be told
        targets = into.where("node <> to").select(F.col("to").alias("node")).distinct()
        further = cut_lineage(into.where("node <> to").join(targets, "node", "left_semi").select(F.col("node").alias("to"), F.col("to").alias("next")))
        if not (rows := further.count()):
            return into, rounds
        rounds += 1
        into = cut_lineage(into.join(small(further, rows), "to", "left").select("node", F.coalesce("next", "to").alias("to")))


def contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, component), the least node reachable over the links (a, b), and the number of rounds.

    Each node points at its least neighbour if that is less; pointers are followed to their roots, and every tree becomes one node. Two such steps at least halve
    the nodes that are not done.
    """
    edges = cut_lineage(links.select("a", "b"))
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    first, rounds = True, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        into, jumps = jumped(into)
        rounds += 1 + jumps
        rows = into.count()
        if first:
            labels, first = into.select("node", F.col("to").alias("component")), False
        else:
            to = small(into.select(F.col("node").alias("component"), "to"), rows)
            labels = cut_lineage(labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        left = edges.join(small(into.withColumnRenamed("node", "a"), rows), "a").select(F.col("to").alias("a"), "b")
        right = left.join(small(into.withColumnRenamed("node", "b").withColumnRenamed("to", "c"), rows), "b").select("a", F.col("c").alias("b"))
        edges = cut_lineage(right.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels, rounds


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b)."""
    return contracted(links)[0]


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def cross_pairs(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of one bucket and two components. ``members`` have bucket, node, component and n, the members of the bucket.

    A bucket of n members has ceil(n / BLOCK) blocks, dealt by hash; each pair of blocks, and each block with itself, is a key of its own, so no task
    compares more than BLOCK members with BLOCK others.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(77)), blocks).cast("int")
    dealt = members.select("bucket", "node", "component", blocks.alias("blocks"), block.alias("block")).join(facts, "node")
    upper = dealt.select("*", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other")).drop("blocks")
    lower = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other")).drop("blocks")
    x, y = told(upper, "x").withColumnRenamed("bucket", "bucket_x"), told(lower, "y")
    meet = (F.col("bucket_x") == F.col("bucket")) & (F.col("block_x") == F.col("other_y")) & (F.col("other_x") == F.col("block_y"))
    once = (F.col("block_x") < F.col("block_y")) | (F.col("node_x") < F.col("node_y"))
    joined = x.join(y, meet & once & (F.col("component_x") != F.col("component_y")) & likely(percent))
    return joined.select(*ordered(F.col("node_x"), F.col("node_y")))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id (the least key reachable) and kept (key = component_id)."""
    rows = cut_lineage(sketch_documents(df, text, key, percent).withColumnRenamed(key, "id"))
    linkable = rows.where("n_shingles > 0 and id is not null")
    classes = cut_lineage(linkable.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in FACTS]))
    entries = classes.select(F.explode("bands").alias("bucket"), "node")
    picks = entries.groupBy("bucket").agg(
        F.min("node").alias("c0"), F.max("node").alias("last"), *[F.min_by("node", F.xxhash64("node", F.lit(s))).alias(f"c{i}") for i, s in enumerate(CENTRE_SEEDS, 1)]
    )
    shared = entries.join(picks.where("c0 < last"), "bucket")
    buckets = cut_lineage(shared.select("bucket", "node", F.array("c0", "c1", "c2").alias("centres")))
    nodes = cut_lineage(buckets.select("node").distinct())
    facts = classes.select("node", "n_shingles", *FACTS)
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    sets = df.join(wanted, df[key] == wanted["node"], "left_semi").select(F.col(f"`{key}`").alias("node"), F.col(f"`{text}`").alias("text"))
    sets = cut_lineage(set_bytes(sets, "text", "node").groupBy("node").agg(F.min("shingles").alias("shingles")))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(told(facts, "x").withColumnRenamed("node_x", "a"), "a").join(told(facts, "y").withColumnRenamed("node_y", "b"), "b")
        close = both.where(likely(percent)).select("a", "b")
        full = close.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
        return similar(full.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b"), percent)

    pairs = buckets.select("node", F.explode(F.array_distinct("centres")).alias("centre")).where("node <> centre").select(*ordered(F.col("node"), F.col("centre"))).distinct()
    links = cut_lineage(verified(pairs))
    label = components(links)
    before = None
    for step in range(MORE_ROUNDS + 1):
        named = buckets.select("bucket", "node").join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        ranges = named.groupBy("bucket").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
            F.min_by(F.struct("node", "component"), F.xxhash64("component", F.lit(20 + step))).alias("centre"),
        )
        undone = cut_lineage(named.join(ranges.where("lo < hi"), "bucket").select("bucket", "node", "component", "n", "centre"))
        pairs_left, members = undone.agg(F.sum("n"), F.count("*")).first()
        if not members:
            break
        last = step == MORE_ROUNDS or pairs_left <= MANY * members or (before is not None and pairs_left > 0.9 * before)
        before = pairs_left
        if last:
            more = cross_pairs(undone.select("bucket", "node", "component", "n"), facts, percent)
        else:
            more = undone.where("component <> centre.component").select(*ordered(F.col("node"), F.col("centre.node")))
        found = cut_lineage(verified(more.distinct().join(pairs, ["a", "b"], "left_anti")))
        if not found.isEmpty():
            links = links.union(found)
            label = components(links)
        if last:
            break
    named = classes.join(label, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    full = rows.select("id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return full.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """df without the rows that are not kept; all columns stay."""
    gone = near_duplicates(df, text, key, percent).where("not kept").select(F.col(key).alias("__gone")).distinct()
    return df.join(gone, df[key] == gone["__gone"], "left_anti")
