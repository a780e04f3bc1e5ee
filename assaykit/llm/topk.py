"""Exact top-k search by inner product as a Voronoi kNN join.

Largest inner product becomes nearest neighbour on a sphere: with ``M`` the length of the longest data vector, data become
``(x, sqrt(M^2 - |x|^2))`` and queries ``(q, 0) * M / |q|``, all of length ``M``, and the nearer a data vector, the larger its
product. Pivots split the data into Voronoi cells. First, every query is solved within its nearest cells that hold more
than ``k`` vectors; the distance of its k-th answer there is its bound. Second, queries that lie near each other travel in
blocks, with what all of a block's queries can still use: by the triangle inequality and by the plane between two
pivots, a query needs only some cells, and of a cell only vectors at certain distances from its pivot. Blocks are
solved locally with exact whole-number scores, and the answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.lineage import cut
from assaykit.llm.common import runs_of

#: Rows that pivots are chosen from (smallest by md5 of the id), and most pivots; their number is the root of the rows'.
SAMPLE, PIVOTS = 8_192, 1_024
#: Queries of a block; about eight times as many vectors meet them in a task.
BLOCK = 1_024
#: Relative slack on distance bounds, far above rounding error; bounds only decide what travels.
SLACK = 1e-6


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as float64 rows, shorter ones padded with zeros."""
    n = np.array(pc.list_value_length(lists).to_pylist(), np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _on_sphere(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more coordinate, all of length ``sqrt(longest)``; a zero query is as near to all."""
    square = (x**2).sum(1)
    if query:
        return np.concatenate([x * np.sqrt(longest / np.where(square > 0, square, 1))[:, None], np.zeros((len(x), 1))], axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(longest - square, 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 where no sum can leave its exact range, else in whole numbers."""
    if not q.size or not x.size or q.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max()) < 2.0**52:
        return (q @ x.T).astype(np.int64)
    return (q.astype(np.int64).astype(object) @ x.T.astype(np.int64).astype(object)).astype(np.int64)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample."""
    centres = sample[:count].copy()
    for _ in range(6):
        near = _distances(sample, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _solve(k: int, width: int):
    """The ``k`` best of the right table for every row of the left one, but for rows of the same id."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, queries = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(ids) and len(queries):
            x = _matrix(right.column("z").combine_chunks(), width)[order]
            q = _matrix(left.column("q").combine_chunks(), width)
            for query_id, s in zip(queries, _scores(q, x)):
                keep = np.flatnonzero(ids != query_id)
                if len(keep) > k:
                    least = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[s[keep] >= least]
                best = keep[np.argsort(-s[keep], kind="stable")[:k]]
                out_q.append(np.full(len(best), query_id))
                out_v.append(ids[best])
                out_s.append(s[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return solve


def _meet(asked: DataFrame, sent: DataFrame, keys: list[str], k: int, width: int) -> DataFrame:
    left, right = asked.groupBy(*keys), sent.groupBy(*keys)
    return left.cogroup(right).applyInArrow(_solve(k, width), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, query_modulus: int = 50, scale: int = 256, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each query, ties to smaller ids.

    ``vectors`` has ``vec_id, embedding``; each component becomes ``floor(scale * x)`` in double. Queries are the rows
    whose id ``query_modulus`` divides, candidates all rows but the query's own id. Vectors (or ids) that are null, and
    vectors with a null or non-finite component, take no part; shorter vectors count as padded with zeros. Fewer than
    ``k`` candidates give fewer rows. A row that repeats an id is one more candidate; of query rows that repeat an id one
    is asked, the first by its vector. An empty table gives no rows; further columns are ignored.
    """
    return _top_k(vectors, k, query_modulus, scale, pivots, block)[0]


def _top_k(vectors: DataFrame, k: int, query_modulus: int, scale: int, pivots: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The answers, and the rows that travelled to blocks of queries in the second step."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL")
    bad = "exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    v = v.where(f"NOT {bad}").select("vec_id", F.expr(f"transform(e, x -> CAST(floor({scale} * CAST(x AS double)) AS bigint))").alias("z"))
    v = v.withColumn("norm", F.expr("aggregate(z, 0D, (a, x) -> a + CAST(x AS double) * CAST(x AS double))"))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("width"), F.max("norm").alias("norm")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size["n"]:
        return none, none
    width, longest = max(1, size["width"]), float(size["norm"])
    wanted = int(min(pivots, max(2, round(size["n"] ** 0.5))))
    rows = v.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "z").limit(SAMPLE).select("z").collect()
    sample = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        sample[i, : len(r["z"])] = r["z"]
    centres = _pivots(_on_sphere(sample, longest, False), wanted)
    slack = SLACK * (longest**0.5 + 1)

    def assign(query: bool):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4_096):
                    part = b.slice(at, 4_096)
                    d = _distances(_on_sphere(_matrix(part.column(1), width), longest, query), centres)
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "z", "cell", "dist"])

        return kernel

    schema = "vec_id long, z array<bigint>, cell int, dist double"
    data = cut(v.select("vec_id", "z").mapInArrow(assign(False), schema))
    asked = v.where(F.col("vec_id") % query_modulus == 0).groupBy("vec_id").agg(F.min("z").alias("z"))
    asked = cut(asked.mapInArrow(assign(True), schema).select(F.col("vec_id").alias("query_id"), F.col("z").alias("q"), F.col("cell").alias("home")))
    # Summaries: a row for each cell, at most ``pivots`` of them.
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not homes:
        return none, none
    there = np.array(sorted(cells))
    count, low, high = (np.array([cells[c][x] for c in there.tolist()]) for x in ("n", "lo", "hi"))
    between = _distances(centres, centres)
    parts = lambda n: -(-int(n) // block)

    # First: the nearest cells that hold more than k others, for the queries of each home cell.
    first = []
    for home, n in homes.items():
        near = np.argsort(between[home, there], kind="stable")
        near = near[: 1 + int(np.searchsorted(np.cumsum(count[near]), k + 1))]
        first += [(home, int(there[j]), parts(n), parts(count[j])) for j in near]
    first = F.broadcast(spark.createDataFrame(first, "home int, cell int, q_parts int, d_parts int"))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["home", "cell", "q_part", "d_part"]
    sent = data.join(first, "cell").select("home", "cell", every("q_parts").alias("q_part"), part("vec_id", "d_parts").alias("d_part"), "vec_id", "z")
    asks = asked.join(first, "home").select("home", "cell", part("query_id", "q_parts").alias("q_part"), every("d_parts").alias("d_part"), "query_id", "q")
    bounds = _best(_meet(asks, sent, keys, k, width), k).groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("found"))

    # Second: blocks of queries that stand near each other. A block holds queries of neighbouring homes, in the order of a
    # walk from pivot to nearest pivot; a home with more than a block's queries has blocks of its own.
    walk, left = [], set(range(len(centres)))
    while left:
        rest = np.array(sorted(left))
        walk.append(int(rest[between[walk[-1], rest].argmin()]) if walk else 0)
        left.remove(walk[-1])
    blocks, held, number = [], 0, 0
    for home in (c for c in walk if c in homes):
        if held and held + homes[home] > block:
            held, number = 0, number + 1
        blocks.append((home, number, parts(homes[home])))
        held, number = (held + homes[home], number) if homes[home] <= block else (0, number + parts(homes[home]))
    blocks = F.broadcast(spark.createDataFrame(blocks, "home int, first int, parts int"))
    asked = asked.join(bounds, "query_id", "left").withColumn("score", F.when(F.col("found") >= k, F.col("score")))
    asked = asked.join(blocks, "home").withColumn("block", F.col("first") + part("query_id", "parts")).select("block", "home", "query_id", "q", "score")
    asked = cut(asked.repartition("block").sortWithinPartitions("block"))

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and cell the nearest and farthest distance from its pivot that some query of the block needs."""
        for b in runs_of(batches, 1):
            near, far = np.full(len(there), np.inf), np.full(len(there), -np.inf)
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                x, home = _matrix(rows.column(2), width), rows.column(1).to_numpy()
                length = np.sqrt((x**2).sum(1))
                d = _distances(_on_sphere(x, longest, True), centres)
                # The score of the k-th answer so far, as a distance on the sphere; without one, no bound.
                score = rows.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False)
                reach = np.sqrt(np.maximum(2 * longest - 2 * longest**0.5 * score / np.where(length > 0, length, 1), 0))
                reach = np.where(np.isnan(score) | (length == 0), np.inf, reach)[:, None] + slack
                apart = between[home][:, there]
                plane = (d[:, there] ** 2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * np.where(apart > 0, apart, 1))
                need = (np.where(apart > 0, plane, 0) <= reach) & (d[:, there] - reach <= high) & (d[:, there] + reach >= low)
                near = np.minimum(near, np.where(need, d[:, there] - reach, np.inf).min(0))
                far = np.maximum(far, np.where(need, d[:, there] + reach, -np.inf).max(0))
            ok = np.flatnonzero(near <= far)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), b.column(0)[0].as_py()), pa.int32()), pa.array(there[ok], pa.int32()), pa.array(near[ok]), pa.array(far[ok]), pa.array(count[ok], pa.int64())], ["block", "cell", "lo", "hi", "n"])

    routes = asked.select("block", "home", "q", "score").mapInArrow(reaches, "block int, cell int, lo double, hi double, n long")
    # A block can stand in more than one task.
    routes = cut(routes.groupBy("block", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")))
    tasks = routes.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(8 * block)).cast("int").alias("d_parts"))
    routes = cut(routes.join(tasks, "block").drop("n"))
    sent = data.join(routes, "cell").where((F.col("dist") >= F.col("lo")) & (F.col("dist") <= F.col("hi")))
    sent = sent.select("block", part("vec_id", "d_parts").alias("d_part"), "vec_id", "z")
    asks = asked.join(tasks, "block").select("block", every("d_parts").alias("d_part"), "query_id", "q")
    found = _best(_meet(asks, sent, ["block", "d_part"], k, width), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), sent
