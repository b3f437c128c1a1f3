"""Embedding vectors: centroids, best matches, strata, neighbours, pair statistics, cluster quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions import text as fx
from textmill.operators.lineage import cut


#: Numbers of a matrix that is handed to every task; more vectors take more passes.
MATRIX_CELLS = 1 << 22


def matrices(df: DataFrame, key: str, vector: str, others: tuple[str, ...] = (), cells: int = MATRIX_CELLS) -> Iterator[dict[str, np.ndarray]]:
    """The rows of df as matrices of at most ``cells`` numbers each: {key, vector, others...}, rows with nulls left out.

    Rows are dealt to parts by hash of the key, so each part is read by itself and the driver holds one at a time.
    """
    whole = df.select(key, *others, F.col(vector).cast("array<double>").alias(vector)).dropna()
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    parts = -(-facts["n"] * (facts["width"] or 0) // cells) if facts["n"] else 0
    for part in range(parts):
        rows = whole.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part).toArrow()
        if rows.num_rows:
            yield {c: rows[c].to_numpy() for c in (key, *others)} | {vector: stacked(rows[vector].combine_chunks(), facts["width"])}


def stacked(vectors: pa.Array, width: int) -> np.ndarray:
    """A matrix of vectors; those of another width are NaN."""
    size = np.diff(np.asarray(vectors.offsets))
    out = np.full((len(vectors), width), np.nan)
    good = size == width
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[good] = flat[np.repeat(good, size)].reshape(-1, width)
    return out


Task = tuple[Callable[[dict, np.ndarray, np.ndarray], "pa.RecordBatch | None"], Callable[[], "pa.RecordBatch | None"]]


def against(points: DataFrame, key: str, vector: str, others: tuple[str, ...], queries: dict[str, np.ndarray], schema: str, begin: Callable[[dict], Task]) -> DataFrame:
    """Every point against one matrix of queries, a block of points at a time, in one multiplication.

    begin(queries) gives two functions for a task: one that takes the columns of a block, its vectors and their products with all queries (block x queries) and
    may give rows, and one that gives the task's last rows. Points with nulls or of another width are left out.
    """
    shared = points.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = begin(shared.value)
        matrix = shared.value[vector]
        rows = max(1, MATRIX_CELLS // max(1, len(matrix)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                block = batch.slice(at, rows)
                held = stacked(block.column(1 + len(others)), matrix.shape[1])
                whole = ~np.isnan(held).any(1)
                block, held = block.filter(pa.array(whole)), held[whole]
                if len(held) and (made := add({c: block.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate((key, *others))}, held, held @ matrix.T)) is not None:
                    yield made
        if (made := finish()) is not None:
            yield made

    return points.select(key, *others, F.col(vector).cast("array<double>").alias(vector)).dropna().mapInArrow(run, schema)


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, n, centroid): means by coordinate; a row a coordinate is aggregated before it is shuffled."""
    cells = df.select(label, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(ordered, lambda x: x["m"]).alias("centroid"))


def label_similarity(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(a, b, similarity) of all label centroids, a < b; labels are few, so the smaller side is joined as it is."""
    c = centroids(df, vector, label)
    x, y = c.select(F.col(label).alias("a"), F.col("centroid").alias("va")), c.select(F.col(label).alias("b"), F.col("centroid").alias("vb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", fx.cosine(F.col("va"), F.col("vb")).alias("similarity"))


def stratum(similarity: Column, bounds: dict[str, tuple[float, float]]) -> Column:
    """The first stratum with lo <= similarity < hi; null outside all."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(bounds.items())):
        out = F.when((similarity >= lo) & (similarity < hi), F.lit(name)).otherwise(out)
    return out


def nearest(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, cells: int = MATRIX_CELLS) -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar other points (dot product, then key) of a stated set of queries.

    Queries are multiplied with blocks of points, a matrix of at most ``cells`` numbers a pass; a task keeps the k best of each query, so k rows a query and task are shuffled. Keys
    are integers. Vectors with nulls, NaN or of another width than the longest are like none.
    """

    def best(matrix: dict) -> Task:
        held: list[np.ndarray] = []  # query row, neighbour, similarity

        def add(columns: dict, _, product: np.ndarray) -> None:
            ids = columns[key].astype(np.int64)
            scores = product.T.copy()
            scores[matrix[key][:, None] == ids[None, :]] = -np.inf
            if scores.shape[1] > k:
                floor = np.partition(scores, -k, axis=1)[:, -k]
                row, at = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            else:
                row, at = np.nonzero(scores > -np.inf)
            new = (row, ids[at], scores[row, at])
            row, other, score = (np.concatenate(x) for x in zip(held, new)) if held else new
            order = np.lexsort((other, -score, row))
            row, other, score = row[order], other[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            held[:] = [x[place < k] for x in (row, other, score)]

        def finish() -> pa.RecordBatch | None:
            if not held:
                return None
            return pa.RecordBatch.from_arrays([pa.array(matrix[key][held[0]].astype(np.int64)), pa.array(held[1]), pa.array(held[2])], names=["query", "neighbour", "similarity"])

        return add, finish

    found = None
    for shared in matrices(queries, key, vector, cells=cells):
        made = against(points, key, vector, (), shared, "query long, neighbour long, similarity double", best)
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = points.sparkSession.createDataFrame([], "query long, neighbour long, similarity double")
    order = W.partitionBy("query").orderBy(F.desc("similarity"), F.asc("neighbour"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


PAIR_SUMS = "same boolean, pairs long, total double, least double, most double, closeness double"


def pair_statistics(queries: DataFrame, points: DataFrame, key: str, vector: str, label: str, cells: int = MATRIX_CELLS) -> DataFrame:
    """(same, pairs, mean, least, most, uniformity) of the dot products of a stated set of queries and all points of a larger key, by equality of labels.

    Each task adds up its own products; two rows a task and pass are shuffled. uniformity is the mean of exp(-2 * (2 - 2 * product)).
    """

    def sums(matrix: dict) -> Task:
        held = {same: [0, 0.0, np.inf, -np.inf, 0.0] for same in (True, False)}

        def add(columns: dict, _, product: np.ndarray) -> None:
            later = columns[key][:, None] > matrix[key][None, :]
            alike = columns[label][:, None] == matrix[label][None, :]
            for same, h in held.items():
                x = product[later & (alike == same)]
                if len(x):
                    h[:] = [h[0] + len(x), h[1] + x.sum(), min(h[2], x.min()), max(h[3], x.max()), h[4] + np.exp(-2 * (2 - 2 * x)).sum()]

        def finish() -> pa.RecordBatch | None:
            rows = [(same, *map(float, h)) for same, h in held.items() if h[0]]
            if not rows:
                return None
            names = [n.split()[0] for n in PAIR_SUMS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c).cast(pa.int64()) if n == "pairs" else pa.array(c) for n, c in zip(names, zip(*rows))], names=names)

        return add, finish

    made = points.sparkSession.createDataFrame([], PAIR_SUMS)
    for matrix in matrices(queries, key, vector, (label,), cells):
        made = made.unionByName(against(points, key, vector, (label,), matrix, PAIR_SUMS, sums))
    n = F.sum("pairs")
    return made.groupBy("same").agg(n.alias("pairs"), (F.sum("total") / n).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"), (F.sum("closeness") / n).alias("uniformity"))


def silhouettes(df: DataFrame, key: str, vector: str, label: str, cells: int = MATRIX_CELLS) -> DataFrame:
    """(key, label, silhouette) of every vector, exactly, for squared Euclidean distance.

    The mean distance of x from a cluster is |x|^2 - 2 x.m + q, where m is the cluster's mean and q its mean of |y|^2; so each vector is multiplied with the
    means and never with other vectors: n * k products, not n * n. In a cluster of one it is 0; without a second cluster it is null. Keys tell rows apart; rows with nulls or a vector shorter than the longest are left out.
    """
    rows = df.select(key, label, F.col(vector).cast("array<double>").alias(vector)).dropna()
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    rows = rows.where((F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    squares = rows.groupBy(label).agg(F.avg(fx.dot(F.col(vector), F.col(vector))).alias("square"))
    clusters = cut(centroids(rows, vector, label).withColumnRenamed("centroid", vector).join(squares, label))

    def distances(matrix: dict) -> Task:
        place = {name: i for i, name in enumerate(matrix[label].tolist())}

        def add(columns: dict, held: np.ndarray, product: np.ndarray) -> pa.RecordBatch:
            far = (held * held).sum(1)[:, None] - 2 * product + matrix["square"][None, :]
            mine = np.array([place.get(x, -1) for x in columns[label].tolist()])
            has, at = mine >= 0, np.arange(len(mine))
            size = matrix["n"][mine]
            own = np.where(size > 1, far[at, mine] * size / np.maximum(size - 1, 1), np.nan)
            far[at[has], mine[has]] = np.inf
            other = far.min(1)
            arrays = [pa.array(columns[key]), pa.array(columns[label]), pa.array(np.maximum(own, 0), mask=~has), pa.array(np.maximum(other, 0), mask=~np.isfinite(other))]
            return pa.RecordBatch.from_arrays(arrays, names=[key, label, "own", "other"])

        return add, lambda: None

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{key}` {kind[key]}, `{label}` {kind[label]}, own double, other double"
    found = None
    for matrix in matrices(clusters, label, vector, ("n", "square"), cells):
        made = against(rows, key, vector, (label,), matrix, schema, distances)
        found = made if found is None else found.unionByName(made)
    if found is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind[key]}, `{label}` {kind[label]}, silhouette double")
    if cells < MATRIX_CELLS or clusters.agg(F.sum(F.size(vector))).first()[0] > cells:
        found = found.groupBy(key, label).agg(F.max("own").alias("own"), F.min("other").alias("other"))
    wide = F.greatest("own", "other")
    value = F.when(F.isnan("own"), F.lit(0.0)).when(wide == 0, F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / wide)
    return found.select(key, label, F.when(F.col("other").isNotNull(), value).alias("silhouette"))


def cluster_sums(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz index from sums by coordinate: between / (k - 1) over within / (n - k)."""
    cells = df.select(label, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    own = cells.groupBy(label, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    by_i = own.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"), F.count("*").alias("k"))
    total = by_i.agg(F.sum(F.col("g") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("q") - F.col("g")).alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    return total.select("n", "k", "between", "within", (F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
