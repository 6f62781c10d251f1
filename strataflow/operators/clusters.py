"""Neighbours, clusters and their summaries over vectors.

Nearest neighbours: the stated query rows, in blocks of bounded size, are sent to the tasks; each task keeps
the k best of its rows per query and only those are merged. Clusters and components come from MLlib.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import BROADCAST_LIMIT, cut, join_groups
from strataflow.operators import ordered

#: Query vectors in one block.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: Distances worked out at a time in a task.
CELLS = 1 << 22
#: Vectors that the lists of the approximate search are fitted to, at most.
FITTED = 50_000


def _merge(kept: tuple, q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> tuple:
    """The k best of each query among those kept and new ones (query number, distance, id); ties go to the smaller id."""
    q, d, i = (np.concatenate(pair) for pair in zip(kept, (q, d, i)))
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    first = np.searchsorted(q, q)
    best = np.arange(len(q)) - first < k
    return q[best], d[best], i[best]


def _scan(ids: np.ndarray, points: np.ndarray, own: np.ndarray, values: np.ndarray, kept: tuple, k: int) -> tuple:
    """Hold the rows of a batch against the queries in blocks: products of matrices find the candidates, their distances are then worked out exactly."""
    squares, norm = (values * values).sum(axis=1), (points * points).sum(axis=1)
    step = max(1, CELLS // max(len(values), 1))
    limit = np.full(len(ids), np.inf)
    counts = np.bincount(kept[0], minlength=len(ids))
    full = counts >= k
    if full.any():
        limit[full] = np.maximum.reduceat(kept[1], np.searchsorted(kept[0], np.arange(len(ids)))[full]) if full.all() else np.array([kept[1][kept[0] == j].max() for j in np.flatnonzero(full)])
    found_q, found_v = [], []
    for a in range(0, len(ids), step):
        d2 = norm[a : a + step, None] + squares[None] - 2.0 * (points[a : a + step] @ values.T)
        d2[ids[a : a + step, None] == own[None]] = np.inf
        top = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
        slack = 1e-9 * (norm[a : a + step] + squares.max(initial=0.0))  # what rounding may add to a difference of squares
        at = np.minimum(top, limit[a : a + step] ** 2) + slack
        q, v = np.nonzero((d2 <= at[:, None]) & np.isfinite(d2))
        found_q.append(q + a)
        found_v.append(v)
    q, v = np.concatenate(found_q), np.concatenate(found_v)
    d = np.concatenate([np.sqrt(((points[q[a : a + CELLS // 64]] - values[v[a : a + CELLS // 64]]) ** 2).sum(axis=1)) for a in range(0, len(q), CELLS // 64)] or [np.zeros(0)])
    return _merge(kept, q, d, own[v], k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", centers: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The k nearest other rows of each query row: `query`, `neighbour`, `distance`, `rank`; ties go to the smaller id.

    Exact; with `centers` each row belongs to the list of its nearest center, and a query looks into its `probes` nearest lists only.
    """
    parts = []
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.select(key, vector).where(F.col(vector).isNotNull()).collect()
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), centers))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, points, middles = shared.value
            kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            looked = None
            if middles is not None and len(ids):
                apart = ((points[:, None] - middles[None]) ** 2).sum(axis=2)
                looked = np.zeros(apart.shape, bool)
                np.put_along_axis(looked, np.argsort(apart, axis=1)[:, :probes], True, axis=1)
            for batch in batches:
                own = batch.column(0).to_numpy()
                if not len(own) or not len(ids):
                    continue
                values = np.array(batch.column(1).to_pylist(), float)
                if looked is None:
                    kept = _scan(ids, points, own, values, kept, k)
                    continue
                lists = (-2.0 * values @ middles.T + (middles * middles).sum(axis=1)).argmin(axis=1)
                for at in np.unique(lists):
                    asked, inside = np.flatnonzero(looked[:, at]), lists == at
                    if len(asked):
                        local = _scan(ids[asked], points[asked], own[inside], values[inside], (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), k)
                        kept = _merge(kept, asked[local[0]], local[1], local[2], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], names=["query", "neighbour", "distance"])

        parts.append(vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(best, "query long, neighbour long, distance double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_approximately(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 32, probes: int = 12, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As `nearest`, by an inverted file: `lists` centers are fitted by k-means to at most about FITTED rows, every row is in the list of its nearest center, each query looks into `probes` lists."""
    count = vectors.count()
    sample = vectors if count <= FITTED else vectors.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(FITTED / count * (1 << 30)))
    data = sample.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if data.limit(1).count() == 0:
        return nearest(vectors, queries, k, key, vector)
    model = KMeans(k=lists, seed=seed, maxIter=15).fit(data)
    return nearest(vectors, queries, k, key, vector, np.array(model.clusterCenters()), probes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact neighbours that were found."""
    hits = exact.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hits.groupBy("query").agg((F.count("hit") / F.count("*")).alias("recall"))


def neighbour_agreement(neighbours: DataFrame, vectors: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Share of each query's neighbours that carry its label, and the entropy (bits) of their labels."""
    labels = vectors.select(F.col(key), F.col(label).alias("_l"))
    joined = neighbours.join(labels.withColumnRenamed(key, "query").withColumnRenamed("_l", "own"), "query").join(labels.withColumnRenamed(key, "neighbour").withColumnRenamed("_l", "other"), "neighbour")
    counts = joined.groupBy("query", "own", "other").count()
    sized = counts.groupBy("query").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("own") == F.col("other"), F.col("count")).otherwise(0)).alias("same"), F.sum(F.col("count") * F.log2("count")).alias("c"))
    return sized.select("query", (F.col("same") / F.col("n")).alias("agreement"), (F.log2("n") - F.col("c") / F.col("n")).alias("entropy"))


def shared_neighbour_graph(neighbours: DataFrame) -> DataFrame:
    """Jaccard weight of each neighbour pair whose both ends are queries: shared over all neighbours of the two, one edge per pair."""
    lists = neighbours.groupBy("query").agg(F.collect_set("neighbour").alias("near"))  # k ids each
    edges = neighbours.select("query", "neighbour")
    a = edges.join(lists, "query")
    both = a.join(lists.select(F.col("query").alias("neighbour"), F.col("near").alias("other")), "neighbour")
    low, high = F.least("query", "neighbour"), F.greatest("query", "neighbour")
    weight = F.size(F.array_intersect("near", "other")) / F.size(F.array_union("near", "other"))
    return both.select(low.alias("a"), high.alias("b"), weight.alias("weight")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by spreading the smallest label until none changes; lineage is cut by checkpoints.

    Each round a row takes the smallest label of its neighbours, hands it to the row whose id is its own label (the root),
    and jumps to its label's label; so labels cross finished clusters at once and even long paths take few rounds.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = known.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(known.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = cut(both)
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c"))
    changed = 1
    while changed:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        sent = labels.join(near, "u")
        roots = sent.groupBy(F.col("c").alias("u")).agg(F.min("m").alias("h"))
        step = sent.join(roots, "u", "left").select("u", F.least("c", "m", "h").alias("n"), "c")
        jump = step.alias("s").join(labels.select(F.col("u").alias("n"), F.col("c").alias("j")), "n", "left").select("u", F.least("n", "j").alias("n"), "c")
        new = cut(jump)
        changed = new.where("n != c").limit(1).count()
        labels = new.select("u", F.col("n").alias("c"))
    return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean of each coordinate per group: `by`, `coordinate` (from 0), `value`."""
    return vectors.select(by, F.posexplode(vector).alias("coordinate", "x")).groupBy(by, "coordinate").agg(F.avg(F.col("x").cast("double")).alias("value"))


def nearest_centroid(vectors: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The group whose centroid is nearest to each row; ties go to the smaller group.

    Centroids whose size is within the limit travel as one array; more of them are sent in blocks of that size, and each row keeps the best of all.
    """
    means = centroids(vectors, by, vector).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("coordinate", "value"))), lambda s: s["value"]).alias("c"))
    means = cut(means)
    size = means.agg(F.sum(F.size("c") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // BROADCAST_LIMIT))
    best = F.array_min(F.transform("_m", lambda m: F.struct(distance(F.col(vector), m["c"]).alias("d"), m["g"].alias("g"))))
    parts = []
    for k in range(blocks):
        block = means if blocks == 1 else means.where(F.pmod(F.xxhash64(by), F.lit(blocks)) == k)
        table = block.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("g"), "c"))).alias("_m"))
        parts.append(vectors.crossJoin(F.broadcast(table)).select(key, best.alias("_b")))  # one row of at most about BROADCAST_LIMIT bytes
    if blocks == 1:
        return parts[0].select(key, F.col("_b.g").alias("nearest"), F.col("_b.d").alias("distance"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min("_b").alias("_b")).select(key, F.col("_b.g").alias("nearest"), F.col("_b.d").alias("distance"))


def summaries(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Per cluster and coordinate: count, median, mean and quartiles, and beside them the mean of all other clusters' rows (`rest`)."""
    long = vectors.select(by, F.posexplode(vector).alias("coordinate", "x")).withColumn("x", F.col("x").cast("double"))
    q = ordered.quantiles(long, [by, "coordinate"], {"x": F.col("x")}, [0.25, 0.5, 0.75], beside=[F.sum("x").alias("sum")])
    all_rows = q.groupBy("coordinate").agg(F.sum("sum").alias("_s"), F.sum("n_x").alias("_n"))
    joined = q.join(all_rows, "coordinate")
    rest = F.when(F.col("_n") > F.col("n_x"), (F.col("_s") - F.col("sum")) / (F.col("_n") - F.col("n_x")))
    return joined.select(by, "coordinate", F.col("n_x").alias("n"), F.col("q_x")[0].alias("q25"), F.col("q_x")[1].alias("median"), F.col("q_x")[2].alias("q75"), F.when(F.col("n_x") > 0, F.col("sum") / F.col("n_x")).alias("mean"), rest.alias("rest"))


def abundance(df: DataFrame, sample: str, cluster: str) -> DataFrame:
    counts = df.groupBy(sample, cluster).count()
    total = counts.groupBy(sample).agg(F.sum("count").alias("total"))
    return counts.join(total, sample).select(sample, cluster, "count", (100.0 * F.col("count") / F.col("total")).alias("percent"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, one row, from their contingency counts."""
    cells = df.groupBy(a, b).count()
    rows, columns = cells.groupBy(a).agg(F.sum("count").alias("r")), cells.groupBy(b).agg(F.sum("count").alias("c"))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    plogp = lambda c: F.sum(F.col(c) * F.log(F.col(c).cast("double")))
    x = cells.agg(pairs("count").alias("s"), plogp("count").alias("lab"), F.sum("count").alias("n"))
    y = rows.agg(pairs("r").alias("sa"), plogp("r").alias("la"))
    z = columns.agg(pairs("c").alias("sb"), plogp("c").alias("lb"))
    n = F.col("n").cast("double")
    expected = F.col("sa") * F.col("sb") / (n * (n - 1) / 2)
    h = lambda c: F.log(n) - F.col(c) / n
    mutual = h("la") + h("lb") - h("lab")
    joined = x.crossJoin(y).crossJoin(z)  # one row each
    return joined.select(((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"), F.when(h("la") * h("lb") > 0, mutual / F.sqrt(h("la") * h("lb"))).alias("nmi"))


def kmeans(vectors: DataFrame, k: int, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, initMode="k-means||", maxIter=30).fit(data).transform(data).select(key, F.col("prediction").alias("cluster"))


def principal(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(data).transform(data).select(key, vector_to_array("p").alias("components"))


def self_organising_map(vectors: DataFrame, rows: int, columns: int, epochs: int = 8, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Batch map: every epoch sums the vectors per node in the tasks, and the few node sums are smoothed over the grid on the driver."""
    nodes = rows * columns
    grid = np.array([(i // columns, i % columns) for i in range(nodes)], float)
    apart = ((grid[:, None] - grid[None]) ** 2).sum(axis=2)
    spread = vectors.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("at").collect()
    rng = np.random.default_rng(seed)
    codes = np.array([r.m for r in spread]) + rng.normal(size=(nodes, len(spread))) * np.array([r.s for r in spread]) * 0.5
    for epoch in range(epochs):
        shared = vectors.sparkSession.sparkContext.broadcast(codes)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x = np.array(batch.column(0).to_pylist(), float)
                if len(x):
                    at = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["node", "n", "total"])

        parts = vectors.select(vector).mapInArrow(sums, "node long, n long, total array<double>").select("node", "n", F.posexplode("total").alias("at", "x")).groupBy("node", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        total, n = np.zeros_like(codes), np.zeros(nodes)
        for r in parts:
            total[r.node, r["at"]] = r.x
            n[r.node] = r.n
        radius = max(rows, columns) / 2 * (0.5 / (max(rows, columns) / 2)) ** (epoch / max(epochs - 1, 1))
        weight = np.exp(-apart / (2 * radius * radius))
        mass = weight @ n
        codes = np.where(mass[:, None] > 1e-12, (weight @ total) / np.maximum(mass, 1e-12)[:, None], codes)
    final = vectors.sparkSession.sparkContext.broadcast(codes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = final.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, c.shape[1])
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int64)), pa.array(np.sqrt(d[np.arange(len(at)), at]))], names=[key, "node", "distance"])

    return vectors.select(key, vector).mapInArrow(place, f"{key} long, node long, distance double")


def preserved(vectors: DataFrame, queries: DataFrame, low: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Share of each query's k nearest rows that are also among its k nearest in the low-dimensional `low` (an array column)."""
    near = nearest(vectors, queries, k, key, vector).select("query", "neighbour")
    other = nearest(vectors.select(key, low.alias("_low")), queries.select(key, low.alias("_low")), k, key, "_low").select("query", "neighbour", F.lit(1).alias("hit"))
    return near.join(other, ["query", "neighbour"], "left").groupBy("query").agg((F.count("hit") / F.count("*")).alias("preserved"))


def enrichment(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Each group's mean per coordinate in standard deviations from the mean of all rows."""
    long = vectors.select(by, F.posexplode(vector).alias("coordinate", "x"))
    whole = long.groupBy("coordinate").agg(F.avg(F.col("x").cast("double")).alias("_m"), F.stddev_samp(F.col("x").cast("double")).alias("_s"))
    return centroids(vectors, by, vector).join(whole, "coordinate").select(by, "coordinate", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).alias("score"))
