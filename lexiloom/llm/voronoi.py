"""Exact top-k by inner product, as a Voronoi kNN join.

Pivots cut the space into cells. Each cell is summed up by its number of vectors and their largest distance from
the pivot. For a query cell i (pivot p, radius s) and a data cell j (pivot c, radius r), every score lies within
s * |c| + (|p| + s) * r of <p, c>, by Cauchy-Schwarz. The lower bounds of the cells that hold k + 1 vectors give a
score that every query of i reaches k times; cells whose upper bound is below it are not sent to i. Query
cells are joined to groups of bounded size, data to blocks of bounded size; blocks are solved alone (skipping cells
by the same bound for single queries), and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import workspace

#: Pivots: the root of the number of vectors, within these bounds.
PIVOTS = (16, 512)
#: Vectors that the pivots are chosen from (a bounded sample; cells and bounds cover all vectors).
PIVOT_SAMPLE = 4096
QUERY_GROUP = 4096
DATA_BLOCK = 16_384
_WIDE = pa.decimal128(38, 0)
#: Vectors that are scored at once.
PART = 1024


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component (at the nearest long beyond longs); vectors that are null or hold null or
    non-finite components are left out."""
    wide = F.transform(column, lambda x: x.cast("double"))
    finite = F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return rows.filter(finite).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer rows padded with zeros to one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int, seed: int = 29) -> np.ndarray:
    """Seeded k-means++ and three Lloyd rounds."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(sample)))]
    near = np.square(sample - sample[at[0]]).sum(axis=1)
    while len(at) < min(count, len(sample)) and near.max() > 0:
        at.append(int(rng.choice(len(sample), p=near / near.sum())))
        near = np.minimum(near, np.square(sample - sample[at[-1]]).sum(axis=1))
    pivots = sample[at].astype(float)
    for _ in range(3):
        cell = _nearest(sample, pivots)[0]
        for j in range(len(pivots)):
            if (cell == j).any():
                pivots[j] = sample[cell == j].mean(axis=0)
    return pivots


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = np.square(pivots).sum(axis=1) - 2 * x @ pivots.T
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.square(x - pivots[cell]).sum(axis=1))


def needed_cells(pivots: np.ndarray, queries: dict[int, tuple[int, float]], cells: dict[int, tuple[int, float]], k: int, own: int = 1) -> dict[int, list[int]]:
    """For each query cell, the data cells that may hold one of a query's k best. Values: (vectors, radius). own: rows that may share the query's id."""
    norm = np.sqrt(np.square(pivots).sum(axis=1))
    out = {}
    for i, (_, s) in queries.items():
        mid = {j: float(pivots[i] @ pivots[j]) for j in cells}
        slack = {j: s * norm[j] + (norm[i] + s) * r for j, (_, r) in cells.items()}
        have, reach = 0, -np.inf
        for j in sorted(cells, key=lambda j: slack[j] - mid[j]):
            have += cells[j][0]
            if have >= k + own:
                reach = mid[j] - slack[j]
                break
        out[i] = [j for j in cells if mid[j] + slack[j] >= reach - 1e-6 * (1 + abs(reach))]
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: int64, or Python integers where these could overflow."""
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = top(q) * top(x) * q.shape[1]
    if bound < 1 << 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return q @ x.T
    return q.astype(object) @ x.T.astype(object)


def solve_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, cell: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best in the block, ties to smaller ids. q and x hold integers; floating-point
    bounds, with slack, only choose what is scored."""
    qf, xf = q.astype(float), x.astype(float)
    norm = np.sqrt(np.square(qf).sum(axis=1))
    best = np.full(len(q), -np.inf)
    row, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.zeros(0, np.int64)
    groups = []
    for j in np.unique(cell):
        at = np.flatnonzero(cell == j)
        radius = np.sqrt(np.square(xf[at] - pivots[j]).sum(axis=1)).max()
        groups.append((qf @ pivots[j] + norm * radius, at))
    slack = lambda: 1e-6 * (1 + np.abs(best, where=np.isfinite(best), out=np.zeros_like(best)))
    for upper, at in sorted(groups, key=lambda g: -g[0].max(initial=0)):
        for part in np.array_split(at, max(1, -(-len(at) // PART))):
            live = np.flatnonzero(upper >= best - slack())
            if not len(live):
                continue
            s = _scores(q[live], x[part])
            r, c = np.nonzero((s.astype(float) >= (best - slack())[live][:, None]) & (qid[live][:, None] != xid[part][None, :]))
            row, ids, score = np.concatenate([row, live[r]]), np.concatenate([ids, xid[part][c]]), np.concatenate([score, s[r, c]])
            if score.dtype == object:
                order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64)
            else:
                order = np.lexsort((ids, ~score, row))  # ~x falls as x rises, without overflow
            row, ids, score = row[order], ids[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, ids, score, place = row[place < k], ids[place < k], score[place < k], place[place < k]
            full = np.flatnonzero(place == k - 1)
            best[row[full]] = score[full].astype(float)
    return row, ids, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries(vec_id, v)``, the k vectors of ``vectors(vec_id, v)`` with the
    largest inner product, ties to the smaller vec_id, never one with the query's own vec_id.

    v holds integers; vectors of unequal length are padded with zeros. Fewer than k candidates give fewer rows. Repeated
    candidate rows count each; a repeated query row is answered once. Null ids take no part. Empty tables give no rows.
    Scores are exact and ranked as integers of any size; the column shows those beyond longs as the nearest long.
    """
    spark = vectors.sparkSession
    workspace.ship(spark)
    data = workspace.materialize(vectors.filter("vec_id is not null"), "vectors")
    asked = workspace.materialize(queries.filter("vec_id is not null").dropDuplicates(["vec_id", "v"]), "queries")
    width = data.select(F.size("v").alias("n")).union(asked.select(F.size("v"))).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    sample = np.array([r.v + [0] * (width - len(r.v)) for r in data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).collect()], float)
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(sample) or not width:
        sample = np.zeros((1, max(width, 1)))
        width = max(width, 1)
    size = data.agg(F.count(F.lit(1))).first()[0]
    pivots = choose_pivots(sample, int(min(PIVOTS[1], max(PIVOTS[0], size**0.5))))
    own = data.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cell, dist = _nearest(_matrix(batch.column("v"), width).astype(float), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(dist)], names=["vec_id", "v", "cell", "dist"])

    in_cells = lambda df, name: workspace.materialize(df.mapInArrow(assign, "vec_id long, v array<long>, cell int, dist double"), name)
    data, asked = in_cells(data, "cells"), in_cells(asked, "query_cells")
    summary = lambda df: {r[0]: (r[1], r[2]) for r in df.groupBy("cell").agg(F.count(F.lit(1)), F.max("dist")).collect()}
    cells, asked_cells = summary(data), summary(asked)
    need = needed_cells(pivots, asked_cells, cells, k, own)

    # near query cells share a group until it is full; a cell that is larger than a group is split
    groups: list[tuple[list[int], int]] = []
    left = sorted(need)
    while left:
        at = left.pop(0)
        own, n = [at], asked_cells[at][0]
        for j in sorted(left, key=lambda j: float(np.square(pivots[at] - pivots[j]).sum())):
            if n + asked_cells[j][0] <= QUERY_GROUP:
                own.append(j)
                left.remove(j)
                n += asked_cells[j][0]
        groups.append((own, n))
    plan_q, plan_x, g = [], [], 0
    for own, n in groups:
        wanted = sorted({j for i in own for j in need[i]})
        blocks = -(-sum(cells[j][0] for j in wanted) // DATA_BLOCK)
        splits = -(-n // QUERY_GROUP)
        plan_q += [(i, g, splits, blocks) for i in own]
        plan_x += [(j, g, splits, blocks) for j in wanted]
        g += splits
    plan = lambda rows: F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["cell", "g", "splits", "blocks"]).astype(int) if rows else [], "cell int, g int, splits int, blocks int"))
    place = F.xxhash64("vec_id", "v")
    q = asked.join(plan(plan_q), "cell").select("vec_id", "v", (F.col("g") + F.pmod(place, F.col("splits"))).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x = data.join(plan(plan_x), "cell").select("vec_id", "v", "cell", F.pmod(place, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.col("g"), F.col("g") + F.col("splits") - 1)).alias("grp"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = lambda t: t.column("vec_id").to_numpy()
        qid = ids(a)
        row, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            row, vec, score = solve_block(qid, _matrix(a.column("v"), width), ids(b), _matrix(b.column("v"), width), b.column("cell").to_numpy(), pivots, k)
        return pa.table({"query_id": pa.array(qid[row], pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array([Decimal(int(x)) for x in score], _WIDE) if score.dtype == object else pa.array(score).cast(_WIDE)})

    found = q.groupBy("grp", "block").cogroup(x.groupBy("grp", "block")).applyInArrow(solve, "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("score", F.greatest(F.least("score", F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long")).select(*[x.split()[0] for x in schema.split(", ")])
