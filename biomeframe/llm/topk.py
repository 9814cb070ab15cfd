"""Exact top-k inner products over norm-sorted blocks.

Vectors become integers, floor(256 * x). They are range-partitioned by descending
length and packed into blocks. The head, a bounded number of the longest vectors, gives
every query a first threshold. The blocks form lanes in that order; a query is sent
only to the lanes whose largest length times its own reaches its threshold (Cauchy-Schwarz),
the first few of them, and queries that reach equally far travel together. In a lane queries that its blocks cannot
serve drop out by the same bound; for the others the inner product
over the leading axes of an SVD rotation plus the product of the residual lengths
bounds the score, and only candidates whose bound reaches the threshold are
scored exactly. A block pair returns at most k rows per query, so nothing grows
with a query's matches; thresholds rise while a task's blocks pass. What tasks are told about the lanes
is at most ``LANES`` numbers. Queries and blocks meet by being read, ``GROUPS_A_TASK`` groups of queries and one file part of
blocks at a time: neither is copied per lane, in an exchange or in a broadcast. The driver gets the head and numbers per block.

Defined results: null vectors, vectors with null, NaN or infinite components and
rows with a null id take no part; shorter vectors count as padded with zeros;
an empty vector scores 0; rows that repeat an id are candidates of their own,
but a query's own id never is, and of rows that repeat a query's id the one whose
vector's bytes come first is the query; ties go to the smaller id; scores beyond 64 bits
become the largest long; fewer than k candidates give all; only id and vector are read; empty
tables give no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.session import LARGE_ROWS, arrow_rows, materialise

TOP, SCALE = 5, 256
BLOCK, QUERY_BLOCK, HEAD = 2048, 1024, 4096
BLOCKS_A_LANE, LANES, LEADING = 2, 65_536, 24
QUERIES_TOGETHER = 128
GROUPS_A_TASK, PAIRS_A_BATCH, DENSE = 32, 8, 0.05
log = logging.getLogger(__name__)
EXACT = 2.0**53
LONG_MAX = 2**63 - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (int64 bytes), norm and dim of every vector that takes part."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter("vec_id IS NOT NULL AND v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).offsets.to_numpy().astype(np.int64)
            x = batch.column(1).values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(float)
            dims, row = np.diff(at), np.repeat(np.arange(batch.num_rows), np.diff(at))
            ok = np.bincount(row[~np.isfinite(x)], minlength=batch.num_rows) == 0
            x, dims, row = x[ok[row]], dims[ok], row[ok[row]]
            n = np.clip(np.floor(SCALE * x), -(2.0**62), 2.0**62)
            norms = np.sqrt(np.bincount(row, np.square(n), minlength=batch.num_rows))[ok]
            ends = np.concatenate([[0], np.cumsum(8 * dims)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer(ends), pa.py_buffer(n.astype("<i8"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(ok)), packed, pa.array(norms, pa.float64()), pa.array(dims, pa.int32())],
                names=["vec_id", "v", "norm", "dim"],
            )

    return rows.mapInArrow(run, "vec_id long, v binary, norm double, dim int")


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Axes of all vectors in descending order of their share, from a dim x dim sum per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            x = padded(batch.column(0).to_pylist(), dim).astype(float)
            gram += x.T @ x
        yield pa.RecordBatch.from_pydict({"g": [gram.ravel().tolist()]})

    parts = rows.select("v").mapInArrow(run, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(dim * dim)
    for r in sums:
        gram[r["i"]] = r["g"]
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1]


def padded(vectors: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(8 * dim, b"\0") for v in vectors), "<i8").reshape(-1, dim)


def blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows in their order as blocks: ids and vectors as bytes, largest norm, row count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(part: list[tuple]) -> pa.RecordBatch:
            ids, vectors, norms = zip(*part, strict=True)
            return pa.RecordBatch.from_pydict(
                {
                    "ids": [np.array(ids, "<i8").tobytes()],
                    "vectors": [padded(list(vectors), dim).tobytes()],
                    "norm": [max(norms)],
                    "n": [len(part)],
                }
            )

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    return rows.select("vec_id", "v", "norm").mapInArrow(run, "ids binary, vectors binary, norm double, n long")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if len(q) and len(c) and float(np.abs(q).max()) * float(np.abs(c).max()) * max(1, q.shape[1]) >= EXACT:
        big = q.astype(object) @ c.astype(object).T
        return np.array([[max(-LONG_MAX, min(LONG_MAX, int(x))) for x in row] for row in big], np.int64).reshape(big.shape)
    return (q.astype(float) @ c.astype(float).T).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best scores, the query's own id left out, ties to the smaller id."""
    at = np.flatnonzero(ids != own)
    if len(at) > 4 * k:
        floor = np.partition(scores[at], -k)[-k]
        at = at[scores[at] >= floor]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def lanes_of(stored: DataFrame, per_lane: int) -> tuple[DataFrame, np.ndarray]:
    """Blocks with their lane, ``per_lane`` neighbours in the order of lengths, and the largest length of each lane.

    ``at`` of a block is its partition and its place there; partitions are ranges of lengths.
    """
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in stored.select(part.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    ordinal = F.get(F.lit(starts), part.cast("int")).cast("long") + row
    placed = stored.withColumn("lane", F.floor(ordinal / per_lane))
    norms = sorted((r["lane"], r["norm"]) for r in placed.groupBy("lane").agg(F.max("norm").alias("norm")).collect())
    return placed, np.array([n for _, n in norms])


def reaches(lengths: np.ndarray, floors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """How many of the lanes, longest first, can hold a score that a query's floor lets through."""
    with np.errstate(divide="ignore", invalid="ignore"):
        least = (floors.astype(float) - 1) / (lengths * (1 + 1e-9))
    least = np.where(lengths > 0, least, np.where(floors <= 1, -np.inf, np.inf))
    # A hair less, so that rounding never drops a lane.
    least = least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0.0))
    return np.searchsorted(-norms, -least, side="right")


def thresholds(queries: DataFrame, head: tuple[np.ndarray, np.ndarray], dim: int, k: int, norms: np.ndarray) -> DataFrame:
    """Queries with their k-th best score among the head (-2^63 where that has fewer), in small groups
    that reach the first ``reach`` lanes."""
    head_ids, head_vectors = head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = products(unpacked(vectors, dim), head_vectors)
                floors = []
                for own, s in zip(np.frombuffer(ids, "<i8"), scores, strict=True):
                    found = best(head_ids, s, own, k)
                    floors.append(int(s[found[-1]]) if len(found) == k else -LONG_MAX - 1)
                q, own_ids, floors = unpacked(vectors, dim), np.frombuffer(ids, "<i8"), np.array(floors, "<i8")
                far = reaches(np.sqrt(np.square(q.astype(float)).sum(1)), floors, norms)
                order = np.argsort(far, kind="stable")
                groups = [order[i : i + QUERIES_TOGETHER] for i in range(0, len(order), QUERIES_TOGETHER)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "q_ids": [own_ids[g].tobytes() for g in groups],
                        "q_vectors": [q[g].tobytes() for g in groups],
                        "floors": [floors[g].tobytes() for g in groups],
                        "reach": [int(far[g].max()) for g in groups],
                    }
                )

    return queries.mapInArrow(run, "q_ids binary, q_vectors binary, floors binary, reach long")


def longest(stored: DataFrame, size: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``size`` longest rows: of the first blocks, whose places are looked up as numbers."""
    first = stored.select("at", "n").orderBy("at").limit(size).collect()
    enough = int(np.searchsorted(np.cumsum([r["n"] for r in first]), size))
    last = first[min(enough, len(first) - 1)]["at"]
    found = sorted(map(tuple, stored.filter(F.col("at") <= last).select("at", "ids", "vectors").collect()))
    ids = np.concatenate([np.frombuffer(r[1], "<i8") for r in found])
    return ids[:size], np.concatenate([unpacked(r[2], dim) for r in found])[:size]


def rotated(c: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading axes, lengths of the rest and whole lengths of rows turned to ``axes``."""
    r = c.astype(float) @ axes
    return r[:, :LEADING], np.sqrt(np.square(r[:, LEADING:]).sum(1)), np.sqrt(np.square(r).sum(1))


def candidates(
    q: np.ndarray, floors: np.ndarray, c: np.ndarray, norm: float, axes: np.ndarray, turned: tuple | None = None
) -> Iterator[tuple]:
    """(query row, candidate rows) that the bounds leave. ``turned`` is ``rotated(c, axes)`` where that is known."""
    lengths = np.sqrt(np.square(q.astype(float)).sum(1))
    alive = np.flatnonzero(lengths * norm * (1 + 1e-9) + 1 >= floors)
    if not len(alive):
        return
    q_lead, q_rest, _ = rotated(q[alive], axes)
    c_lead, c_rest, c_size = turned or rotated(c, axes)
    bound = q_lead @ c_lead.T
    bound += np.outer(q_rest, c_rest)
    bound += np.outer(1e-9 * lengths[alive], c_size)
    for row, reach in zip(alive, bound + 1 >= floors[alive, None], strict=True):
        found = np.flatnonzero(reach)
        if len(found):
            yield row, found


def small(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether inner products of these rows are exact in doubles."""
    return float(np.abs(q).max()) * float(np.abs(c).max()) * max(1, q.shape[1]) < EXACT


def scored_candidates(q: np.ndarray, c: np.ndarray, found: list[tuple]) -> Iterator[tuple]:
    """(query row, candidate rows, their exact scores): in one product where the bounds leave many."""
    rows = [row for row, _ in found]
    if rows and sum(len(at) for _, at in found) >= DENSE * len(rows) * len(c) and small(q[rows], c):
        yield from ((row, at, s[at]) for (row, at), s in zip(found, products(q[rows], c), strict=True))
    else:
        yield from ((row, at, products(q[row : row + 1], c[at])[0]) for row, at in found)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = TOP,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with all others.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    rows = materialise(integers(vectors, id_col, vector_col))
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    got = rows.agg(
        F.max("dim").alias("dim"), F.count_if(is_query).alias("q"), F.count(F.lit(1)).alias("n")
    ).first()
    if not got["q"]:
        return spark.createDataFrame([], schema)
    dim = max(1, got["dim"])
    axes = rotation(rows, dim)
    by_length = rows.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    stored = materialise(blocks(by_length, dim, BLOCK).withColumn("at", F.monotonically_increasing_id()), **LARGE_ROWS)
    stored, norms = lanes_of(stored, max(BLOCKS_A_LANE, -(-got["n"] // (BLOCK * LANES))))
    head = longest(stored, HEAD, dim)
    once = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("_one"))
    query_rows = once.select("vec_id", "_one.*").repartition(-(-got["q"] // QUERY_BLOCK))
    asked = thresholds(blocks(query_rows, dim, QUERY_BLOCK).select("ids", "vectors"), head, dim, k, norms)
    queries = materialise(asked, **LARGE_ROWS)
    sent = queries.agg(F.sum("reach").alias("sent"), F.count(F.lit(1)).alias("groups")).first()
    log.info("%d of %d pairs of query groups and lanes are joined", sent["sent"], sent["groups"] * len(norms))
    # The right side of a Cartesian product is what a task keeps; the hint rules out a broadcast of it.
    kept = queries.filter("reach > 0").repartition(-(-sent["groups"] // GROUPS_A_TASK)).hint("shuffle_replicate_nl")
    pairs = stored.join(kept, F.col("lane") < F.col("reach")).select("at", "ids", "vectors", "norm", "q_ids", "q_vectors", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best_of = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                here, norm = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                q_ids, q, floors = (np.frombuffer(x[i].as_buffer(), "<i8") for x in batch.columns[4:])
                q = q.reshape(-1, dim)
                if here != at:
                    at, ids = here, np.array(np.frombuffer(batch.column(1)[i].as_buffer(), "<i8"))
                    c = np.array(unpacked(batch.column(2)[i].as_buffer(), dim))
                    turned = rotated(c, axes)
                # The k best scores of this task so far raise what the head told.
                seen = best_of.setdefault(q_ids[0], np.full((len(q_ids), k), -LONG_MAX - 1))
                floors = np.maximum(floors, seen[:, 0])
                out: list[tuple] = []
                for row, found, scores in scored_candidates(q, c, list(candidates(q, floors, c, norm, axes, turned))):
                    enough = scores >= floors[row]
                    if enough.any():
                        found, scores = found[enough], scores[enough]
                        top = best(ids[found], scores, q_ids[row], k)
                        out.append((np.full(len(top), q_ids[row]), ids[found[top]], scores[top]))
                        seen[row] = np.sort(np.concatenate([seen[row], scores[top]]))[-k:]
                if out:
                    columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # A few pairs at a time between Spark and its Python workers.
    with arrow_rows(spark, PAIRS_A_BATCH):
        return materialise(ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
