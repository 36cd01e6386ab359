"""Exact nearest neighbours and how well an embedding keeps them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.plans.joins import split_join
from assayline.plans.moments import covariance, fit_moments
from assayline.plans.scans import collect_sums, feature_array, is_complete, map_rows, sum_over_rows, to_numpy
from assayline.session import cut_lineage

BLOCK_ROWS = 2048
#: Pivots of each of the two levels at most, unless rows are narrow and many; queries that one task compares with a block.
MAX_PIVOTS = 256
QUERY_ROWS = 16_384
#: Numbers in a row up to which distances to pivots are added up column by column.
NARROW = 8
#: Bytes of all pivots up to which there may be more of them, so that cells of narrow rows stay as small as blocks.
PIVOT_BYTES = 32 << 20
#: Bytes of the rows of blocks that are visited together.
HOST_BYTES = 16 << 20


def _within(a: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and distance of all pairs among which the ``k`` nearest and their ties must be.

    ``bound`` gives each row of ``a`` a distance beyond which nothing is wanted.
    """
    centre = b.mean(axis=0)  # data far from zero would lose its digits in the products
    sa, sb = a - centre, b - centre
    na, nb = (sa * sa).sum(1), (sb * sb).sum(1)
    # everything that the rounding of this form of the distance leaves in doubt is measured exactly
    doubt = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (na + nb.max())
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]  # there may be no pair within the bounds
    for start in range(0, len(a), 256):
        rows = slice(start, start + 256)
        square = na[rows, None] - 2 * sa[rows] @ sb.T + nb[None, :]
        width = min(k, len(b))
        limit = np.partition(square, width - 1, axis=1)[:, width - 1] + 2 * doubt[rows]
        if bound is not None:
            limit = np.minimum(limit, bound[rows] ** 2 * (1 + 1e-9) + doubt[rows])
        at, near = np.nonzero(square <= limit[:, None])
        for cut in range(0, len(at), 1 << 16):
            i, j = at[cut:cut + (1 << 16)] + start, near[cut:cut + (1 << 16)]
            found.append((i, j, np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))))
    return tuple(np.concatenate(part) for part in zip(*found))


def _best(ids: pa.Array, others: pa.Array, i: np.ndarray, j: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` pairs of each row, by distance and then by the other row's id, without the row itself."""
    names = pa.concat_arrays([ids, others])
    rank = np.empty(len(names), "int64")
    codes = names.dictionary_encode()
    order = pc.array_sort_indices(codes.dictionary).to_numpy()
    place = np.empty(len(order), "int64")
    place[order] = np.arange(len(order))
    rank = place[codes.indices.to_numpy()]
    apart = rank[i] != rank[len(ids) + j]
    i, j, distance = i[apart], j[apart], distance[apart]
    by = np.lexsort((rank[len(ids) + j], distance, i))
    i, j, distance = i[by], j[by], distance[by]
    first = np.searchsorted(i, i, side="left")
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept], distance[kept]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return to_numpy(table.column(name).combine_chunks())


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


@dataclass(frozen=True)
class _Cells:
    """Two levels of pivots.  A row belongs to the nearest leaf below its nearest top pivot."""

    top: np.ndarray
    leaves: tuple[np.ndarray, ...]  # per top pivot
    first: np.ndarray  # number of the first leaf of each top pivot
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows per leaf
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of leaves about their pivots
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of top pivots about all their rows

    @staticmethod
    def of(top: np.ndarray, leaves: Sequence[np.ndarray]) -> _Cells:
        sizes = np.array([len(x) for x in leaves])
        return _Cells(top, tuple(leaves), np.cumsum(sizes) - sizes)

    @staticmethod
    def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        if x.shape[1] <= NARROW:  # a sum over so few numbers costs more per row than adding up the columns
            square = np.zeros((len(x), len(pivots)))
            for column, p in zip(x.T, pivots.T):
                apart = column[:, None] - p[None, :]
                apart *= apart
                square += apart
            return np.sqrt(square, out=square)
        return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], 1))

    def place(self, x: np.ndarray) -> dict[str, np.ndarray]:
        apart = self._distances(x, self.top)
        over = apart.argmin(1)
        leaf, gap = np.zeros(len(x), "int64"), np.zeros(len(x))
        for t in np.unique(over):
            rows = np.flatnonzero(over == t)
            below = self._distances(x[rows], self.leaves[t])
            near = below.argmin(1)
            leaf[rows], gap[rows] = self.first[t] + near, below[np.arange(len(rows)), near]
        return {"top": over, "cell": leaf, "gap": gap, "far": apart[np.arange(len(x)), over]}

    def reached(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that may hold something within the row's bound."""
        rows, cells = [], []
        wide = bound * (1 + 1e-9)
        apart = self._distances(x, self.top)
        for t, pivots in enumerate(self.leaves):
            near = np.flatnonzero(apart[:, t] - self.reach[t] <= wide)
            if not len(near):
                continue
            numbers = self.first[t] + np.arange(len(pivots))
            i, c = np.nonzero((self._distances(x[near], pivots) - self.radius[numbers] <= wide[near, None]) & (self.counts[numbers] > 0))
            rows.append(near[i])
            cells.append(numbers[c])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, "int64"), np.zeros(0, "int64"))


def _most_pivots(total: int, width: int, block_rows: int) -> int:
    """Pivots of each level that give a leaf to every block, as far as ``PIVOT_BYTES`` allow; at least ``MAX_PIVOTS``."""
    return max(MAX_PIVOTS, min(math.isqrt(total // block_rows) + 1, math.isqrt(PIVOT_BYTES // (8 * width))))


def _points(rows: DataFrame, n: int, id_col: str) -> np.ndarray:
    chosen = rows.orderBy(F.xxhash64(id_col), id_col).select("x").limit(n).toArrow()
    return np.unique(_matrix(chosen, "x"), axis=0)


def _cells_of(rows: DataFrame, id_col: str, total: int, k: int, block_rows: int, max_pivots: int) -> _Cells:
    """Pivots drawn by a hash of the id: as many leaves as there are blocks, at most ``max_pivots`` below each of as many top ones."""
    top = _points(rows, max(1, min(max_pivots, -(-total // block_rows))), id_col)
    cells = _Cells.of(top, [p[None] for p in top])
    if len(top) > 1:
        placed = map_rows(rows, [id_col, "x"], ["x"], lambda b, c=cells: c.place(b["x"]), "cell bigint")
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most max_pivots rows
        wanted = {c: min(max_pivots, -(-n // block_rows)) for c, n in sizes.items() if n > 2 * block_rows}
        below: dict[int, np.ndarray] = {}
        if wanted:
            order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit("leaf"), id_col), id_col)
            chosen = placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_pivots).select("cell", "r", "x").toArrow()
            cell, r, x = _column(chosen, "cell").to_numpy(), _column(chosen, "r").to_numpy(), _matrix(chosen, "x")
            below = {c: np.unique(x[(cell == c) & (r <= n)], axis=0) for c, n in wanted.items()}
        kept = [t for t in range(len(top)) if sizes.get(t, 0)]
        cells = _Cells.of(top[kept], [below.get(t, top[t][None]) for t in kept])
        # Leaves with few rows go: their rows could not bound their own neighbours.
        placed = map_rows(rows, [id_col], ["x"], lambda b, c=cells: c.place(b["x"]), "cell bigint")
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        enough = [[i for i in range(len(p)) if sizes.get(cells.first[t] + i, 0) > 4 * k] for t, p in enumerate(cells.leaves)]
        if any(enough):
            stay = [t for t, e in enumerate(enough) if e]
            cells = _Cells.of(cells.top[stay], [cells.leaves[t][enough[t]] for t in stay])
    stats = map_rows(rows, [id_col], ["x"], lambda b, c=cells: c.place(b["x"]), "top bigint, cell bigint, gap double, far double")
    stats = stats.groupBy("top", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.max("far").alias("far")).collect()
    counts, radius = np.zeros(sum(map(len, cells.leaves)), "int64"), np.zeros(sum(map(len, cells.leaves)))
    reach = np.zeros(len(cells.top))
    for r in stats:
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["gap"]
        reach[r["top"]] = max(reach[r["top"]], r["far"])
    return replace(cells, counts=counts, radius=radius, reach=reach)


def nearest_neighbours(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | str,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int | None = None,
) -> DataFrame:
    """The ``k`` nearest other rows of every row: (id, neighbour, distance, rank).

    Rows are put into cells about two levels of pivots, and cells that are still large are cut into blocks of about ``block_rows``
    rows by a hash of the id.  First every row finds the ``k`` nearest of its own block, which bounds how far its neighbours can
    be.  Then it goes to those other blocks only that its bound reaches, by the triangle inequality on its own distances to pivots, and
    brings back at most ``k`` that are nearer; blocks with many such visitors are copied to several tasks.
    Where nothing can be pruned the work is quadratic, which is the price of exactness.
    Of a point with many copies only the first ``k + 1`` take part; the others are answered from those.
    """
    rows = df.where(is_complete(features)).select(F.col(id_col), feature_array(features).alias("x"))
    # Rows beyond the first k + 1 copies of one point: their neighbours are the first k copies.  Every task keeps k + 1 per point at
    # most before the shuffle, which carries hashes of the point in its place.
    point = [F.xxhash64("x").alias("_h"), F.xxhash64(F.lit("second"), "x").alias("_g")]
    order = Window.partitionBy("_h", "_g").orderBy(id_col)
    copies = rows.select(id_col, *point).withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k + 1)
    crowded = copies.groupBy("_h", "_g").agg(F.array_sort(F.collect_list(id_col)).alias("_copies")).where(F.size("_copies") == k + 1)
    crowded = cut_lineage(crowded)
    surplus = None
    if not crowded.isEmpty():
        marked = split_join(rows.select(id_col, "x", *point), crowded, ["_h", "_g"], "left")
        beyond = F.col("_copies").isNotNull() & (F.col(id_col) > F.get("_copies", F.lit(k)))
        surplus = marked.where(beyond).select(
            id_col, F.posexplode(F.slice("_copies", 1, k)).alias("_place", "neighbour")
        ).select(id_col, "neighbour", F.lit(0.0).alias("distance"), (F.col("_place") + 1).alias("rank"))
        rows = marked.where(~beyond).select(id_col, "x")
    kind = df.schema[id_col].dataType
    block_rows = max(block_rows, 4 * (k + 1))
    total = rows.count()
    if not total:
        return rows.select(id_col, F.col(id_col).alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    most = max_pivots or _most_pivots(total, len(rows.select("x").first()["x"]), block_rows)
    cells = _cells_of(rows, id_col, total, k, block_rows, most)
    blocks = np.maximum(1, -(-cells.counts // block_rows)).astype("int64")
    first_block = np.cumsum(blocks) - blocks

    def block_of(batch):
        cell = cells.place(batch["x"])["cell"]
        return {"block": first_block[cell] + batch["_b"] % blocks[cell]}

    spread = rows.withColumn("_b", F.xxhash64(F.lit("block"), id_col).bitwiseAND(F.lit((1 << 62) - 1)))
    placed = map_rows(spread, [id_col, "x"], ["x", "_b"], block_of, "block bigint")
    pairs = T.StructType([T.StructField("neighbours", T.ArrayType(kind)), T.StructField("distances", T.ArrayType(T.DoubleType()))])

    def own_block(table: pa.Table) -> pa.Table:
        ids, x = _column(table, id_col), _matrix(table, "x")
        i, j, distance = _best(ids, ids, *_within(x, x, k + 1, None), k)
        ends = pa.array(np.searchsorted(i, np.arange(len(x) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, ids.take(pa.array(j))), pa.ListArray.from_arrays(ends, pa.array(distance))]
        return pa.table([*table.columns, *lists], names=[*table.column_names, "neighbours", "distances"])

    known = placed.groupBy("block").applyInArrow(own_block, T.StructType([*placed.schema.fields, *pairs.fields]))
    known = cut_lineage(known)
    near = known.select(id_col, F.explode(F.arrays_zip("neighbours", "distances")).alias("p"))
    near = near.select(id_col, F.col("p.neighbours").alias("neighbour"), F.col("p.distances").alias("distance"))
    if len(first_block) > 1 or blocks[0] > 1:
        near = near.unionByName(_from_other_blocks(known, cells, blocks, first_block, id_col, kind, k, block_rows))
    by_distance = Window.partitionBy(id_col).orderBy("distance", "neighbour")
    near = near.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
    return near if surplus is None else near.unionByName(surplus)


def _together(counts: dict[str, np.ndarray], steps: Sequence[int], query_rows: int, cores: int) -> int:
    """How many blocks to visit at once: more if rows go to nearly all of them anyway, as long as there is work for all cores."""
    alone = counts["1"].sum()
    for g in reversed(steps[1:]):
        visitors = counts[str(g)]
        if visitors.sum() * g <= 1.25 * alone and np.ceil(visitors / query_rows).sum() >= 4 * cores:
            return g
    return 1


def _from_other_blocks(
    known: DataFrame, cells: _Cells, blocks: np.ndarray, first_block: np.ndarray, id_col: str, kind: T.DataType, k: int, block_rows: int
) -> DataFrame:
    """(id, neighbour, distance) of what rows find nearer, or as near, in other blocks than their own.

    Where little can be pruned, what is shuffled is each row once per group of blocks that lie side by side.
    """

    def visits(x: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, cell = cells.reached(x, bound)
        times = blocks[cell]
        row, block = np.repeat(row, times), np.repeat(first_block[cell] - np.cumsum(times) + times, times) + np.arange(times.sum())
        other = block != own[row]
        return row[other], block[other]

    def once(row: np.ndarray, block: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
        """A row goes once to ``together`` blocks that lie side by side, however many of them it is to visit."""
        if together == 1:
            return row, block
        width = n_blocks // together + 1
        return np.divmod(np.unique(row * width + block // together), width)

    bounded = known.select(id_col, "x", "block", F.when(F.size("distances") == k, F.get("distances", F.lit(k - 1))).otherwise(float("inf")).alias("bound"))
    n_blocks = int(blocks.sum())
    most_rows = max(BLOCK_ROWS, HOST_BYTES // (8 * cells.top.shape[1]))
    steps = [1]
    while 2 * steps[-1] * block_rows <= most_rows and steps[-1] < n_blocks:
        steps.append(2 * steps[-1])

    def counted(batch):
        row, block = visits(batch["x"], batch["block"], batch["bound"])
        return {str(g): np.bincount(once(row, block, g)[1], minlength=-(-n_blocks // g)) for g in steps}

    counts = collect_sums(sum_over_rows(bounded.select("x", "block", "bound"), counted))
    together = _together(counts, steps, max(QUERY_ROWS, most_rows), known.sparkSession.sparkContext.defaultParallelism)
    visitors = counts[str(together)]
    parts = np.maximum(1, np.ceil(visitors / (QUERY_ROWS if together == 1 else max(QUERY_ROWS, most_rows)))).astype("int64")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                row, block = visits(to_numpy(rows.column("x")), rows.column("block").to_numpy(), rows.column("bound").to_numpy())
                row, host = once(row, block, together)
                part = rows.column("_b").to_numpy()[row] % parts[host]
                kept = rows.select([id_col, "x", "bound", "block"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(host), pa.array(part)], names=[*kept.schema.names, "host", "part"])

    salted = bounded.withColumn("_b", F.xxhash64(F.lit("part"), id_col).bitwiseAND(F.lit((1 << 62) - 1)))
    fields = {f.name: f for f in salted.schema.fields}
    schema = T.StructType([fields[id_col], fields["x"], fields["bound"], fields["block"], T.StructField("host", T.LongType()), T.StructField("part", T.LongType())])
    queries = salted.mapInArrow(sent, schema)
    visited = np.flatnonzero(visitors)
    copies = known.sparkSession.createDataFrame([(int(b), int(parts[b])) for b in visited], "host bigint, parts bigint")
    hosts = known.select(id_col, "x", "block", F.floor(F.col("block") / together).alias("host")).join(F.broadcast(copies), "host")  # a row per host
    hosts = hosts.select(
        F.col(id_col).alias("_id"), F.col("x").alias("_x"), F.col("block").alias("_block"), F.col("host").alias("_host"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_part"),
    )

    def compared(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        names = [id_col, "neighbour", "distance"]
        if not ours.num_rows or not theirs.num_rows:
            ids = ours.column(id_col) if not ours.num_rows else theirs.column("_id")
            return pa.table([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=names)
        ids, others = _column(ours, id_col), _column(theirs, "_id")
        # a row may meet its own block again, beside others: one place more, for the row itself
        i, j, distance = _within(_matrix(ours, "x"), _matrix(theirs, "_x"), k + 1, _column(ours, "bound").to_numpy())
        new = _column(ours, "block").to_numpy()[i] != _column(theirs, "_block").to_numpy()[j]
        i, j, distance = _best(ids, others, i[new], j[new], distance[new], k)
        return pa.table([ids.take(pa.array(i)), others.take(pa.array(j)), pa.array(distance)], names=names)

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("neighbour", kind), T.StructField("distance", T.DoubleType())])
    return queries.groupBy("host", "part").cogroup(hosts.groupBy("_host", "_part")).applyInArrow(compared, schema)


@F.arrow_udf(T.DoubleType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Euclidean distance of two array columns, a batch at a time."""
    return pa.array(np.sqrt(((to_numpy(a) - to_numpy(b)) ** 2).sum(axis=1)))


def neighbour_excess(rows: DataFrame, id_col: str, space: str, found: DataFrame, best: DataFrame) -> DataFrame:
    """Per row: mean relative excess, in ``space``, of the distances to ``found`` neighbours over the ``best`` ones.

    Both lists are sorted by distance in ``space`` and compared place by place.  A zero
    distance is replaced by the smallest positive one of that row.
    """
    own = rows.select(id_col, feature_array(space).alias("_own"))
    other = rows.select(F.col(id_col).alias("neighbour"), feature_array(space).alias("_other"))
    placed = split_join(found.select(id_col, "neighbour"), other, ["neighbour"]).join(own, id_col)
    reached = (
        placed
        .select(id_col, _distance("_own", "_other").alias("reached"))
        .withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("reached")))
    )
    both = reached.join(best.select(id_col, "rank", F.col("distance").alias("best")), [id_col, "rank"])
    per_row = Window.partitionBy(id_col)
    positive = F.least(
        F.min(F.when(F.col("best") > 0, F.col("best"))).over(per_row),
        F.min(F.when(F.col("reached") > 0, F.col("reached"))).over(per_row),
    )
    least = F.when(F.col("best") > 0, F.col("best")).otherwise(F.col("_positive"))
    far = F.when(F.col("reached") > 0, F.col("reached")).otherwise(F.col("_positive"))
    excess = F.coalesce(F.try_divide(far - least, least), F.lit(0.0))
    return both.withColumn("_positive", positive).groupBy(id_col).agg(F.avg(excess).alias("excess"))


def k3n_terms(df: DataFrame, id_col: str, a: str, b: str, k: int = 10, **options) -> DataFrame:
    """(id, excess) in space ``b`` of the neighbours found in space ``a``."""
    in_a = cut_lineage(nearest_neighbours(df, id_col, a, k, **options))
    in_b = nearest_neighbours(df, id_col, b, k, **options)
    return neighbour_excess(df, id_col, b, in_a, in_b)


def k3n_error(
    df: DataFrame, id_col: str, a: str, b: str, k: int = 10, in_a: DataFrame | None = None, **options
) -> float:
    """Neighbour error of both directions added up; 0 when every neighbourhood is kept.

    ``in_a`` may hold the neighbours in ``a`` when several ``b`` are scored against one ``a``.
    """
    near_a = in_a if in_a is not None else cut_lineage(nearest_neighbours(df, id_col, a, k, **options))
    near_b = cut_lineage(nearest_neighbours(df, id_col, b, k, **options))
    there = neighbour_excess(df, id_col, b, near_a, near_b).select(F.lit("ab").alias("way"), "excess")
    back = neighbour_excess(df, id_col, a, near_b, near_a).select(F.lit("ba").alias("way"), "excess")
    error = sum(r["e"] for r in there.union(back).groupBy("way").agg(F.avg("excess").alias("e")).collect())
    return float(error)


def principal_embedding(
    df: DataFrame, id_col: str, features: Sequence[str] | str, axes: tuple[int, int] = (0, 1), out: str = "t"
) -> DataFrame:
    """(id, array of the scores on two principal axes)."""
    moments = fit_moments(df.withColumn("_zero", F.lit(0.0)), features, "_zero")
    n, mean, products = covariance(moments.total[:-1, :-1])
    vectors = np.linalg.eigh(products / max(n - 1, 1))[1][:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    plane, centre = vectors[list(axes)].T, mean + moments.centre[:-1]
    rows = df.select(id_col, feature_array(features).alias("_x"))
    return map_rows(rows, [id_col], ["_x"], lambda b: {out: (b["_x"] - centre) @ plane}, f"{out} array<double>")


def embedding_sweep(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | str,
    candidates: dict[str, DataFrame],
    k: int = 10,
    **options,
) -> DataFrame:
    """Neighbour error of candidate 2-D embeddings, standardised: (candidate, k3n_error, is_best).

    Each candidate is a table (id, t) with an array of two coordinates.
    """
    scores = []
    base = df.select(id_col, feature_array(features).alias("a"))
    in_a = cut_lineage(nearest_neighbours(base, id_col, "a", k, **options))
    for name, table in candidates.items():
        s = table.agg(*[f(F.col("t")[i]).alias(f"{f.__name__}{i}") for i in range(2) for f in (F.avg, F.stddev_samp)]).first()
        scaled = table.select(id_col, F.array(*[
            (F.col("t")[i] - F.lit(s[f"avg{i}"])) / F.lit(s[f"stddev_samp{i}"] or 1.0) for i in range(2)
        ]).alias("b"))
        scores.append((name, k3n_error(base.join(scaled, id_col), id_col, "a", "b", k, in_a, **options)))
    best = min(range(len(scores)), key=lambda i: scores[i][1])
    rows = [(n, float(v), i == best) for i, (n, v) in enumerate(scores)]
    return df.sparkSession.createDataFrame(rows, "candidate string, k3n_error double, is_best boolean")
