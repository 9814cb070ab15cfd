"""Clusters without labels, their quality, and 2-D coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from biomeframe.functions.scores import ratio
from biomeframe.operators.keyed import attach, hash_order
from biomeframe.operators.normalize import PSEUDO
from biomeframe.operators.vectors import arrays, index_labels, merged_shares, taxa_list, with_vector
from biomeframe.session import LARGE_ROWS, arrow_rows, concurrently, materialise

BLOCK_ROWS, STRIPE_ROWS, PART_BYTES = 2048, 1024, 128 << 20
LANDMARKS = 500


def cluster_rows(counts: DataFrame, samples: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Pseudo-counted shares as vectors, with the taxon order."""
    taxa = taxa_list(counts)
    shares = merged_shares(counts, "pseudocount")
    return with_vector(arrays(shares, taxa, samples, PSEUDO)), taxa


def fit_kmeans(rows: DataFrame, k: int, seed: int = 0) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(rows)


def cluster(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Add ``HC_subCST``: CST0 is the largest cluster, CST1 the next, and so on."""
    rows = materialise(rows)
    found = fit_kmeans(rows, k, seed).transform(rows)
    # At most k rows.
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "cluster")))
    names = sizes.agg(ordered.alias("e")).select(F.posexplode("e").alias("i", "e")).select(
        "e.cluster", F.concat(F.lit("CST"), F.col("i").cast("string")).alias("HC_subCST")
    )
    return attach(found, names, "cluster").drop("cluster", "vector")


def centers(model: KMeansModel, taxa: list[str], spark) -> DataFrame:
    """Cluster centres in long form."""
    rows = [
        (i, t, float(v)) for i, c in enumerate(model.clusterCenters()) for t, v in zip(taxa, c, strict=True)
    ]
    return spark.createDataFrame(rows, "cluster int, taxon string, value double")


def elbow(rows: DataFrame, ks: range = range(1, 10), seed: int = 0) -> DataFrame:
    """Inertia per number of clusters; one cluster's inertia is the total squared deviation."""
    rows = materialise(rows)

    def inertia(k: int) -> tuple[int, float]:
        if k > 1:
            return k, fit_kmeans(rows, k, seed).summary.trainingCost
        stats = rows.select(Summarizer.metrics("variance", "count").summary(F.col("vector")).alias("s"))
        s = stats.select("s.variance", "s.count").first()
        return k, float(s["variance"].toArray().sum() * (s["count"] - 1))

    return rows.sparkSession.createDataFrame(concurrently(inertia, ks), "k int, inertia double")


def _shapes(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, sizes, centres and mean squared distances to the centre of the clusters; classes x features numbers."""
    table = rows.select("cluster", array_to_vector("features").alias("v"))
    found = table.groupBy("cluster").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    found = sorted(found.select("cluster", "s.*").collect(), key=lambda r: r["cluster"])
    sizes = np.array([r["count"] for r in found], float)
    # The summary divides by n - 1.
    spread = np.array([r["variance"].toArray().sum() for r in found]) * (sizes - 1) / np.maximum(sizes, 1)
    return [r["cluster"] for r in found], sizes, np.array([r["mean"].toArray() for r in found]), spread


def needed_clusters(x: np.ndarray, own: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Which clusters' distance sums decide each sample's silhouette: its own, and those that may be nearest.

    The mean distance to a cluster is at least the distance to its centre and at most
    sqrt(distance^2 + spread), so a cluster whose lower bound is above another's upper bound cannot be nearest.
    """
    square = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0.0)
    # Rounding of the expanded square must not drop a cluster.
    slack = 1e-9 * ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :]) + 1e-300
    low, high = np.sqrt(np.maximum(square - slack, 0.0)), np.sqrt(square + slack + spread[None, :])
    mine = np.arange(len(centres))[None, :] == own[:, None]
    least = np.where(mine, np.inf, high).min(1, initial=np.inf)
    return mine | (low <= least[:, None])


def _requests(rows: DataFrame) -> tuple[DataFrame, list[str], np.ndarray]:
    """Rows with the numbers of the clusters that they need, written; cluster names and sizes."""
    names, sizes, centres, spread = _shapes(rows)
    number = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy())
                own = pdf["cluster"].map(number).to_numpy()
                needed = needed_clusters(x, own, centres, spread)
                yield pdf.assign(own=own, targets=[np.flatnonzero(r).tolist() for r in needed])

    schema = StructType([*rows.schema.fields, StructField("own", IntegerType()), StructField("targets", ArrayType(IntegerType()))])
    return materialise(rows.mapInPandas(run, schema)), names, sizes


def _packed(asked: DataFrame, sizes: np.ndarray, block_rows: int) -> DataFrame:
    """Samples as blocks of at most ``block_rows`` rows of one cluster, written: own, block, part, ids, x (doubles),
    mask (samples x clusters: which sums they need) and asks, the clusters that any of them needs."""
    id_type, k = asked.schema["sampleID"].dataType.simpleString(), len(sizes)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        out = []
        for part, start in enumerate(range(0, group.num_rows, block_rows)):
            rows = group.slice(start, block_rows).combine_chunks()
            ids, x, targets = (rows.column(c).combine_chunks() for c in ("sampleID", "features", "targets"))
            mask = np.zeros((len(rows), k), bool)
            counts = np.diff(targets.offsets.to_numpy())
            mask[np.repeat(np.arange(len(rows)), counts), targets.flatten().to_numpy()] = True
            x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float)
            out.append((part, ids.to_pylist(), x.tobytes(), mask.tobytes(), np.flatnonzero(mask.any(0)).tolist()))
        part, ids, x, mask, asks = zip(*out, strict=True)
        return pa.table(
            {
                "own": pa.array([key[0].as_py()] * len(out), pa.int32()),
                "block": pa.array([key[1].as_py()] * len(out), pa.int64()),
                "part": pa.array(part, pa.int32()),
                "ids": pa.array(ids, pa.list_(group.schema.field("sampleID").type)),
                "x": pa.array(x, pa.binary()),
                "mask": pa.array(mask, pa.binary()),
                "asks": pa.array(asks, pa.list_(pa.int32())),
            }
        )

    lanes = F.lit([max(1, math.ceil(n / block_rows)) for n in sizes] or [1])
    lane = F.pmod(F.xxhash64("sampleID", "features"), F.get(lanes, F.col("own")).cast("long"))
    rows = asked.select("sampleID", "features", "targets", "own", lane.alias("block"))
    return materialise(
        rows.groupBy("own", "block").applyInArrow(
            pack, f"own int, block long, part int, ids array<{id_type}>, x binary, mask binary, asks array<int>"
        ),
        **LARGE_ROWS,
    )


def _distances(a: np.ndarray, b: np.ndarray, a_ids: pa.Array, b_ids: pa.Array) -> np.ndarray:
    square = (-2 * a) @ b.T
    square += (a * a).sum(1)[:, None]
    square += (b * b).sum(1)[None, :]
    dist = np.sqrt(np.maximum(square, 0.0, out=square), out=square)
    known = a_ids.unique().drop_null()
    there = pc.index_in(b_ids, known).fill_null(-2).to_numpy(zero_copy_only=False)
    if (there >= 0).any():
        # A sample's distance to itself is zero, also after rounding.
        here = pc.index_in(a_ids, known).fill_null(-1).to_numpy(zero_copy_only=False)
        dist[here[:, None] == there[None, :]] = 0.0
    return dist


def _block_sums(blocks: DataFrame, n_clusters: int) -> DataFrame:
    """sampleID, own, t and the distance sum s of every sample to the members of each cluster t that it needs.

    Every block meets those of the clusters that it asks for. Blocks are read, not shuffled, as often as they meet others;
    what is shuffled are sums, added up per block while its pairs pass.
    """
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    left = blocks.select("own", "block", "part", "ids", "x", "mask", "asks")
    right = blocks.select(F.col("own").alias("t"), F.col("ids").alias("t_ids"), F.col("x").alias("t_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sums, mask = None, None, {}, None

        def done() -> Iterator[pa.RecordBatch]:
            for t, s in sums.items():
                need = np.flatnonzero(mask[:, t])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(need)), pa.array(np.full(len(need), at[0], np.int32)), pa.array(np.full(len(need), t, np.int32)), pa.array(s)],
                    names=["sampleID", "own", "t", "s"],
                )

        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                me = tuple(c[name][i].as_py() for name in ("own", "block", "part"))
                if me != at:
                    yield from done()
                    at, ids, sums = me, c["ids"][i].values, {}
                    mask = np.frombuffer(c["mask"][i].as_py(), bool).reshape(len(ids), n_clusters)
                    x = np.frombuffer(c["x"][i].as_py(), float).reshape(len(ids), -1)
                t, t_ids = c["t"][i].as_py(), c["t_ids"][i].values
                need = np.flatnonzero(mask[:, t])
                other = np.frombuffer(c["t_x"][i].as_py(), float).reshape(len(t_ids), -1)
                sums[t] = sums.get(t, 0.0) + _distances(x[need], other, ids.take(pa.array(need)), t_ids).sum(1)
        yield from done()

    pairs = left.join(right, F.array_contains("asks", F.col("t"))).drop("asks")
    # A pair of blocks at a time between Spark and its Python workers.
    with arrow_rows(blocks.sparkSession, 1):
        return materialise(pairs.mapInArrow(run, f"sampleID {id_type}, own int, t int, s double").groupBy("sampleID", "own", "t").agg(F.sum("s").alias("s")))


def _keyed(rows: DataFrame, cluster: str) -> DataFrame:
    return rows.select("sampleID", F.col(cluster).cast("string").alias("cluster"), "features").filter(F.col("cluster").isNotNull())


def silhouette_samples(rows: DataFrame, cluster: str = "HC_subCST", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette per sample.

    Bounds from the clusters' centres and spreads tell which clusters can be nearest (:func:`needed_clusters`);
    only to those, and to its own, a sample's distances are summed. Samples lie in blocks, which are shuffled
    once; each meets the blocks of the clusters that its samples ask for (:func:`_block_sums`), and a task
    holds two of them at a time. The work is quadratic where clusters overlap, as the measure is, what is written and
    shuffled is not; :func:`silhouette_work` tells how much of the work the bounds save, and ``silhouette`` with
    ``exact=False`` is linear.
    """
    asked, names, sizes = _requests(_keyed(rows, cluster))
    sums = _block_sums(_packed(asked, sizes, block_rows), len(names))
    sums = sums.withColumn("cluster", F.get(F.lit(names or [""]), F.col("own")))
    size = F.get(F.lit([float(n) for n in sizes] or [0.0]), F.col("t"))
    own = F.col("own") == F.col("t")
    per_sample = sums.groupBy("sampleID", "cluster").agg(
        F.max(F.when(own & (size > 1), F.col("s") / (size - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / size)).alias("b"),
    )
    score = ratio(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return per_sample.select(
        "sampleID", F.col("cluster").alias(cluster), F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)).alias("silhouette")
    )


def silhouette_work(rows: DataFrame, cluster: str = "HC_subCST") -> DataFrame:
    """Distances that :func:`silhouette_samples` takes, those of all ordered pairs, and the share saved."""
    asked, _, sizes = _requests(_keyed(rows, cluster))
    taken = F.aggregate("targets", F.lit(0.0), lambda acc, t: acc + F.get(F.lit([float(n) for n in sizes] or [0.0]), t))
    every = F.lit(float(sizes.sum()))
    sums = asked.agg(F.coalesce(F.sum(taken), F.lit(0.0)).alias("taken"), (F.count(F.lit(1)) * every).alias("pairs"))
    return sums.withColumn("saved", ratio(F.col("pairs") - F.col("taken"), F.col("pairs")))


def sorted_silhouettes(samples: DataFrame, cluster: str = "HC_subCST") -> DataFrame:
    """Sample silhouettes sorted inside their cluster, with the cluster's size."""
    sizes = samples.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return attach(samples, sizes, cluster).orderBy(cluster, "silhouette", "sampleID")


def mean_silhouette(rows: DataFrame, cluster: str = "HC_subCST", exact: bool = True) -> DataFrame:
    """Mean silhouette of a labelling; ``exact=False`` uses squared distances in linear work."""
    if exact:
        return silhouette_samples(rows, cluster).agg(F.avg("silhouette").alias("silhouette"))
    data = index_labels(with_vector(rows), label=cluster)
    evaluator = ClusteringEvaluator(featuresCol="vector", predictionCol="label_idx")
    return rows.sparkSession.createDataFrame([(float(evaluator.evaluate(data)),)], "silhouette double")


def _joint_blocks(rows: DataFrame, models: list[KMeansModel], block_rows: int) -> tuple[DataFrame, int]:
    """Samples with the clusters that every model gives them, as blocks, written: at, ids, x (doubles), labels (samples x
    models), again (samples whose id may come again), asks (which sums those need, as in :func:`_requests`) and counts
    (members of all models' clusters). Also the bytes of the vectors.

    Samples lie in the order of their ids, so an id that comes again does so next to itself, or at an end of its partition.
    """
    names = [f"_cluster{i}" for i in range(len(models))]
    for model, name in zip(models, names, strict=True):
        rows = model.setPredictionCol(name).transform(rows)
    rows = rows.select("sampleID", "features", F.array(*names).alias("labels"))
    id_type = rows.schema["sampleID"].dataType.simpleString()
    starts, width = _columns(models)
    several = not rows.groupBy("sampleID").count().filter("count > 1").isEmpty()
    shapes = [_shapes(rows.select("features", F.col("labels")[i].cast("string").alias("cluster"))) for i in range(len(models) * several)]

    def asked(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), width), bool)
        for start, own, (found, _, centres, spread) in zip(starts, labels.T, shapes, strict=True):
            found = np.array(found).astype(int)
            place = np.zeros(width, int)
            place[found] = np.arange(len(found))
            out[:, start + found] = needed_clusters(x, place[own], centres, spread)
        return out

    def block(part: pa.Table, again: np.ndarray) -> pa.RecordBatch:
        ids, x, labels = (c.combine_chunks() for c in part.columns)
        labels = labels.flatten().to_numpy().astype(np.int32).reshape(len(ids), -1)
        counts = np.bincount((labels + starts).ravel(), minlength=width)
        x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float)
        asks = asked(x.reshape(len(ids), -1)[again], labels[again]).tobytes() if again.any() else b""
        columns = (pa.array([ids.to_pylist()], pa.list_(ids.type)), [x.tobytes()], [labels.tobytes()], [again.tobytes()], [asks], [counts.tolist()])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ids", "x", "labels", "again", "asks", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, first = None, None, None
        for batch in batches:
            if batch.num_rows:
                if first is None:
                    first = batch.column(0)[0]
                held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
                while held.num_rows > block_rows:
                    part, held = held.slice(0, block_rows), held.slice(block_rows)
                    yield block(part, repeated(part, last, held.column(0)[0], first))
                    last = part.column(0)[-1]
        if held is not None:
            # The last id of a partition may go on in the next one.
            yield block(held, repeated(held, last, held.column(0)[-1], first))

    def repeated(part: pa.Table, before, after, first) -> np.ndarray:
        if not several:
            return np.zeros(part.num_rows, bool)
        ids = part.column(0).combine_chunks()
        code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
        same = code[1:] == code[:-1]
        again = np.append(same, ids[-1] == after) | np.append(before is not None and ids[0] == before, same)
        return again | (code == code[0] if ids[0] == first else False)

    by = [F.col("sampleID"), F.xxhash64("features")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = f"ids array<{id_type}>, x binary, labels binary, again binary, asks binary, counts array<long>"
    blocks = materialise(ordered.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id()), **LARGE_ROWS)
    return blocks, blocks.agg(F.coalesce(F.sum(F.length("x")), F.lit(0)).alias("b")).first()["b"]


def _columns(models: list[KMeansModel]) -> tuple[np.ndarray, int]:
    """Where each model's clusters begin among those of all models, and how many these are."""
    sizes = [len(m.clusterCenters()) for m in models]
    return np.cumsum([0, *sizes[:-1]]), sum(sizes)


def _joint_sums(blocks: DataFrame, size: int, starts: np.ndarray, width: int) -> DataFrame:
    """at and s: sums of the distances of a block's samples to the members of every model's clusters (samples x clusters), in
    parts to be added up.

    Each pair of blocks is met once, in the task of its two partitions, and its distances serve both blocks and all models.
    A task keeps the blocks of one partition and their sums, one block of the other and a stripe of distances.
    """
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(math.sqrt(2 * cores)), -(-size // PART_BYTES))
    left = blocks.select("at", "ids", "x", "labels").repartition(parts)
    right = left.select(*(F.col(c).alias(f"r_{c}") for c in left.columns)).hint("shuffle_replicate_nl")
    n_models = len(starts)

    def members(labels: bytes) -> np.ndarray:
        found = np.frombuffer(labels, np.int32).reshape(-1, n_models) + starts
        out = np.zeros((len(found), width))
        np.put_along_axis(out, found, 1.0, 1)
        return out

    def row(at: int, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["at", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, others = None, None, {}
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                here, there = c["at"][i].as_py(), c["r_at"][i].as_py()
                if here != at:
                    if at is not None:
                        yield row(at, mine)
                    at, ids, a_in = here, c["ids"][i].values, members(c["labels"][i].as_buffer())
                    a = np.array(np.frombuffer(c["x"][i].as_buffer(), float)).reshape(len(ids), -1)
                    mine = np.zeros(a_in.shape)
                r_ids, b_in = c["r_ids"][i].values, members(c["r_labels"][i].as_buffer())
                b = np.frombuffer(c["r_x"][i].as_buffer(), float).reshape(len(r_ids), -1)
                theirs = None if here == there else others.setdefault(there, np.zeros(b_in.shape))
                for start in range(0, len(a), STRIPE_ROWS):
                    rows = slice(start, start + STRIPE_ROWS)
                    dist = _distances(a[rows], b, ids.slice(start, STRIPE_ROWS), r_ids)
                    mine[rows] += dist @ b_in
                    if theirs is not None:
                        theirs += dist.T @ a_in[rows]
        if at is not None:
            yield row(at, mine)
        for there, s in others.items():
            yield row(there, s)

    return left.join(right, F.col("at") <= F.col("r_at")).mapInArrow(run, "at long, s binary")


def mean_silhouettes(rows: DataFrame, models: list[KMeansModel], block_rows: int = BLOCK_ROWS) -> list[float | None]:
    """Exact mean silhouette of each model's clusters, as :func:`silhouette_samples` defines them, from one pass over all
    pairs of samples (:func:`_joint_sums`)."""
    blocks, size = _joint_blocks(rows, models, block_rows)
    starts, width = _columns(models)
    counted = blocks.select(F.posexplode("counts").alias("t", "n")).groupBy("t").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(width)
    for r in counted:
        sizes[r["t"]] = r["n"]
    ends = [*starts[1:], width]
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def score(sums: pa.Table, block: pa.Table) -> pa.Table:
        ids = block.column("ids")[0].values
        s = sum(np.frombuffer(x.as_buffer(), float) for x in sums.column("s")).reshape(len(ids), width)
        again = np.frombuffer(block.column("again")[0].as_buffer(), bool)
        labels = np.frombuffer(block.column("labels")[0].as_buffer(), np.int32).reshape(len(ids), -1)
        asks = np.zeros(s.shape, bool)
        asks[again] = np.frombuffer(block.column("asks")[0].as_buffer(), bool).reshape(-1, width)
        out = []
        for i, (start, end) in enumerate(zip(starts, ends, strict=True)):
            own, n, part = labels[:, i], sizes[start:end], s[:, start:end]
            mine = np.arange(end - start)[None, :] == own[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                a = part[mine] / np.where(n[own] > 1, n[own] - 1, np.nan)
                b = np.fmin.reduce(np.where(mine | (n == 0), np.nan, part / n), axis=1)
                value = np.nan_to_num((b - a) / np.maximum(a, b), nan=0.0, posinf=0.0, neginf=0.0)
            out.append((i, None, None, None, int((~again).sum()), float(value[~again].sum())))
            for j in np.flatnonzero(again):
                needed = [float(v) if ask else None for v, ask in zip(part[j], asks[j, start:end], strict=True)]
                out.append((i, ids[j].as_py(), int(own[j]), needed, 0, 0.0))
        kinds = (pa.int32(), ids.type, pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64())
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["i", "sampleID", "own", "s", "n", "total"])

    # A pair of blocks at a time between Spark and its Python workers.
    with arrow_rows(blocks.sparkSession, 1):
        sums = _joint_sums(blocks, size, starts, width).groupBy("at")
        both = sums.cogroup(blocks.select("at", "ids", "labels", "again", "asks").groupBy("at"))
        scored = materialise(both.applyInArrow(score, f"i int, sampleID {id_type}, own int, s array<double>, n long, total double"))
    # Rows of one id are one sample of its cluster: their sums are added up.
    lit = lambda values: F.lit([float(v) for v in values])
    ofs = F.get(F.lit([int(v) for v in starts]), F.col("i"))
    single = scored.filter("own IS NOT NULL").select("i", "sampleID", "own", F.posexplode("s").alias("t", "s")).filter("s IS NOT NULL")
    single = single.groupBy("i", "sampleID", "own", "t").agg(F.sum("s").alias("s")).withColumn("size", F.get(lit(sizes), ofs + F.col("t")))
    mine = F.col("own") == F.col("t")
    single = single.groupBy("i", "sampleID", "own").agg(
        F.max(F.when(mine & (F.col("size") > 1), F.col("s") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~mine & (F.col("size") > 0), F.col("s") / F.col("size"))).alias("b"),
    )
    value = F.coalesce(F.nanvl(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)), F.lit(0.0))
    every = scored.filter("own IS NULL").select("i", "n", "total").unionAll(single.select("i", F.lit(1).cast("long"), value))
    found = {r["i"]: r for r in every.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    return [found[i]["total"] / found[i]["n"] if i in found and found[i]["n"] else None for i in range(len(models))]


def silhouette(rows: DataFrame, ks: range = range(2, 10), exact: bool = True, seed: int = 0) -> DataFrame:
    """Mean silhouette per number of clusters.

    Of two clusters a sample's silhouette needs both, so an exact one takes the distances of all pairs of samples. Where ``ks``
    has 2, the other numbers are served by the same distances; else each takes those that its bounds leave.
    """
    rows = materialise(rows)
    if exact and 2 in ks and len(ks) > 1:
        models = concurrently(lambda k: fit_kmeans(rows, k, seed), ks, threads=2)
        values = mean_silhouettes(rows, models)
        return rows.sparkSession.createDataFrame(list(zip(ks, values, strict=True)), "k int, silhouette double")

    def mean(k: int) -> tuple[int, float]:
        found = fit_kmeans(rows, k, seed).transform(rows).drop("vector").persist()
        value = mean_silhouette(found, "cluster", exact).first()[0]
        found.unpersist()
        return k, value

    # Exact ones take the whole cluster each, and set the batches of their session.
    found = concurrently(mean, ks, threads=1 if exact else 4)
    return rows.sparkSession.createDataFrame(found, "k int, silhouette double")


def coords(rows: DataFrame, keep: list[str] = ("sampleID",)) -> DataFrame:
    """First two principal components ``x, y``; each axis points to its largest loading."""
    rows = materialise(rows)
    model = PCA(k=2, inputCol="vector", outputCol="pc").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, i])), i] >= 0 else -1.0 for i in (0, 1)]
    pc = vector_to_array("pc")
    return model.transform(rows).select(*keep, (pc[0] * signs[0]).alias("x"), (pc[1] * signs[1]).alias("y"))


def landmark_coords(
    rows: DataFrame, keep: list[str] = ("sampleID",), landmarks: int = LANDMARKS, seed: int = 0, dims: int = 2
) -> DataFrame:
    """Non-linear coordinates ``x, y``: kernel principal components by Nystroem's method.

    The map is fitted on ``landmarks`` samples, those of smallest hash of the id, under a Gaussian kernel as wide as
    their median distance; every sample is then placed by its similarities to the landmarks, in one pass. Reruns
    agree; with as many landmarks as samples the map is the exact one. Each axis points to its largest
    landmark value. The driver holds landmarks x (features + landmarks) doubles.
    """
    rows = materialise(rows)
    near = rows.select("sampleID", "features").orderBy(hash_order(seed, "sampleID"), "sampleID").limit(landmarks).collect()
    if not near:
        return rows.select(*keep, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    base = np.array([r["features"] for r in near], float)

    def squares(a: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(1)[:, None] + (base * base).sum(1)[None, :] - 2 * a @ base.T, 0.0)

    between = squares(base)
    apart = between[np.triu_indices(len(base), 1)]
    width = float(np.median(apart)) if len(apart) and np.median(apart) > 0 else 1.0
    kernel = np.exp(-between / width)
    columns, whole = kernel.mean(0), float(kernel.mean())
    values, axes = np.linalg.eigh(kernel - columns[:, None] - columns[None, :] + whole)
    values, axes = values[::-1][:dims], axes[:, ::-1][:, :dims]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    real = values > 1e-12 * len(base)
    # A direction without spread is zero for every sample.
    onto = np.zeros((len(base), dims))
    onto[:, : len(values)] = np.where(real, axes * signs / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                k = np.exp(-squares(np.stack(pdf["features"].to_numpy())) / width)
                xy = (k - k.mean(1, keepdims=True) - columns[None, :] + whole) @ onto
                yield pdf.drop(columns="features").assign(x=xy[:, 0], y=xy[:, 1])

    kept = rows.select(*keep, "features")
    schema = StructType([*kept.schema.fields[:-1], StructField("x", DoubleType()), StructField("y", DoubleType())])
    return kept.mapInPandas(run, schema)
