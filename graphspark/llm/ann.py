"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import bound_batches, materialize, release_memory

#: Vectors that the partitions and the classifier are learned from: at least so many, and so many for each partition. The only sample
#: that is learned from; every row is indexed.
SAMPLE, SAMPLE_A_PARTITION = 6000, 40
#: Vectors that aren't learned from and whose exact neighbours in the whole table set how many partitions are probed.
CALIBRATION = 256
NEIGHBOURS = 10
#: Vectors of a partition, about, while there are no more partitions than this.
PARTITION_ROWS = 2000
PARTITIONS = 1024
#: Vectors of a partition are dealt into blocks of about this many, and so are its queries.
BLOCK = 4096
#: Recall that the number of probed partitions is chosen for.
TARGET_RECALL = 0.95
EVERY = 100
#: Vectors of another length than most are searched by brute force, in so many partitions by their length.
ODD_PARTITIONS = 64
HIDDEN = 128


@dataclass
class Model:
    unit: float  # vectors are divided by this first, so that no square overflows
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    @property
    def parts(self) -> int:
        return len(self.layers[-1][1])

    def order(self, x: np.ndarray) -> np.ndarray:
        """The partitions of each vector, the most probable first."""
        return np.argsort(-self.logits(x), 1, kind="stable")

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = (x / self.unit - self.mean) / self.scale
        for w, b in self.layers[:-1]:
            h = np.maximum(h @ w + b, 0)
        w, b = self.layers[-1]
        return h @ w + b


def unit_of(*vectors: np.ndarray) -> float:
    """A power of two near the largest component."""
    return float(2.0 ** np.ceil(np.log2(max([np.abs(v).max(initial=0.0) for v in vectors]) or 1.0)).clip(-1000, 1000))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Rows nearest to each row but itself, in blocks."""
    out, norms, step = [], (x * x).sum(1), max(1, (4 << 20) // len(x))
    for lo in range(0, len(x), step):
        d = norms - 2 * (x[lo : lo + step] @ x.T)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, 1)[:, :k].copy())  # a view would keep the whole block
    return np.concatenate(out)


def partition_graph(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A balanced partition that cuts few edges: halved along principal directions, then refined by moves to the
    partition of most neighbours, as far as it has room."""
    n = len(x)
    label = np.zeros(n, np.int64)
    for _ in range(int(np.log2(parts))):
        new = label * 2
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            y = x[own] - x[own].mean(0)
            direction = np.linalg.svd(y[:: max(1, len(y) // 2000)], full_matrices=False)[2][0]
            new[own[np.argsort(y @ direction, kind="stable")[len(own) // 2 :]]] += 1
        label = new
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    room = int(1.1 * n / parts) + 1
    for _ in range(20):
        code, votes = np.unique(np.concatenate([src * parts + label[dst], dst * parts + label[src]]), return_counts=True)
        row = code // parts
        order = np.lexsort((code % parts, -votes, row))
        best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        want, most, have = label.copy(), np.zeros(n), np.zeros(n)
        want[row[best]], most[row[best]] = code[best] % parts, votes[best]
        mine = label[row] == code % parts
        have[row[mine]] = votes[mine]
        gain, size, moved = most - have, np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[label[i]] -= 1
                size[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


def fit(x: np.ndarray, parts: int, seed: int = 7) -> Model:
    """Partitions the neighbour graph of x, and trains a classifier with one hidden layer on how the neighbours of a vector
    are spread over the partitions."""
    n, dim = x.shape
    unit = unit_of(x)
    x = x.astype(np.float64) / unit
    parts = 1 << int(np.log2(max(1, min(parts, n // (4 * NEIGHBOURS)))))
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if n else (np.zeros(dim), np.ones(dim))
    if parts == 1:
        return Model(unit, mean, scale, [(np.zeros((dim, 1)), np.zeros(1))])
    k = min(NEIGHBOURS, n - 1)
    graph = neighbour_graph(x, k)
    label = partition_graph(x, graph, parts)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z, epochs = (x - mean) / scale, max(6, min(30, 180_000 // n))
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            b = order[lo : lo + 256]
            goal = np.zeros((len(b), parts))
            np.add.at(goal, (np.repeat(np.arange(len(b)), k), label[graph[b]].ravel()), 0.5 / k)
            goal[np.arange(len(b)), label[b]] += 0.5
            h = np.maximum(z[b] @ w[0] + w[1], 0)
            out = h @ w[2] + w[3]
            out = np.exp(out - out.max(1, keepdims=True))
            d = (out / out.sum(1, keepdims=True) - goal) / len(b)
            back = (d @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((z[b].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 0.003 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(unit, mean, scale, [(w[0], w[1]), (w[2], w[3])])


def to_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column without nulls, in double precision."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would overflow or vanish, of vectors divided by the largest difference."""
    diff = x - q
    with np.errstate(over="ignore"):
        out, most = np.sqrt((diff * diff).sum(1)), np.abs(diff).max(1, initial=0.0)
    odd = ((most > 1e150) | (most < 1e-150)) & (most > 0) & np.isfinite(most)
    if odd.any():
        out[odd] = most[odd] * np.sqrt(((diff[odd] / most[odd, None]) ** 2).sum(1))
    return out


def top_k(queries: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k nearest of x but itself: query row, row of x, Euclidean distance. A quick estimate keeps
    all that could be among them, ties included; those are measured exactly, ties go to the smaller id."""
    rows, cols, dist = [], [], []
    unit = unit_of(x, q)
    scaled = x / unit
    norms = (scaled * scaled).sum(1)
    for lo in range(0, len(q) if len(x) else 0, 256):
        part = q[lo : lo + 256] / unit
        own = (part * part).sum(1)
        d = own[:, None] + norms[None, :] - 2 * (part @ scaled.T)
        same = queries[lo : lo + 256, None] == ids[None, :]
        d[same] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, 1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * (own + norms.max()) + 1e-12
        for i in range(len(part)):
            near = np.flatnonzero((d[i] <= kth[i] + slack[i]) & ~same[i])
            exact = distances(x[near], q[lo + i])
            best = np.lexsort((ids[near], exact))[:k]
            rows.append(np.full(len(best), lo + i)), cols.append(near[best]), dist.append(exact[best])
    cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
    return cat(rows, np.int64), cat(cols, np.int64), cat(dist, np.float64)


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrate(index: DataFrame, model: Model, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Recall of these vectors' k exact neighbours in the whole index when 1, 2, ... partitions are probed: one pass over the index,
    which keeps k rows a vector and task."""
    dim = q.shape[1]
    shared = index.sparkSession.sparkContext.broadcast((ids, q))
    names = ["query_id", "vec_id", "part", "score"]

    def scan(batches):
        qs, q = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]
        for batch in batches:
            vec, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            r, c, d = top_k(qs, vec, q, to_matrix(batch.column(1), dim), k)
            held = [np.concatenate(x) for x in zip(held, (qs[r], vec[c], part[c], d))]
            order = np.lexsort((held[1], held[3], held[0]))
            begin = np.flatnonzero(np.concatenate([[True], np.diff(held[0][order]) != 0])) if len(order) else order
            place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            held = [x[order[place < k]] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)

    near = nearest_of(index.where(F.col("part") < model.parts).select("vec_id", "embedding", "part").mapInArrow(scan, "query_id long, vec_id long, part int, score double"), k).collect()
    place = np.argsort(model.order(q), 1)
    at = {int(i): r for r, i in enumerate(ids)}
    depth = np.array([place[at[r["query_id"]], r["part"]] for r in near])
    return np.array([(depth < p).mean() if len(depth) else 1.0 for p in range(1, model.parts + 1)])


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = 10, parts: int = PARTITIONS, target: float = TARGET_RECALL, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of every row whose id is divisible by `every`.

    Partitions (about one for PARTITION_ROWS vectors, `parts` at most: beyond that they grow) and classifier are fitted on a bounded sample
    chosen by a hash of the id; every row is indexed in its most probable partition. A query probes its most probable partitions: as
    many as give CALIBRATION other vectors, which weren't learned from, `target` of their exact neighbours in the whole table; more
    while they hold too few vectors. Candidates and queries meet in blocks of a partition, so that neither a large partition nor many
    copies of one vector land in one task; queries travel, and candidates only repeat where a partition has more than BLOCK queries.
    report: takes the number of partitions, of probes, and the recall measured.
    Vectors that are null, zero or empty, or with null or non-finite components take no part, nor do null ids. Vectors of another length
    than the most common one have a distance to their own length only, and are compared with all of it. Rows that repeat are candidates
    each, except for the query's own id, and a query's id asks once, with the smallest of its vectors; ties go to the smaller id. Distances beyond the range of a double are infinite. An empty
    table, or a table of one vector, gives an empty table. Other columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    bound_batches(spark)
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    e = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    rows = rows.where(~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(e, lambda c: c != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["n"], sizes[0]["count"]
    wanted = 1 << int(np.clip(np.round(np.log2(max(1, total / PARTITION_ROWS))), 4, int(np.log2(parts))))
    u = F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 30)) / float(1 << 30)
    rate = min(0.9, max(SAMPLE, SAMPLE_A_PARTITION * wanted) / total)

    def drawn(condition) -> DataFrame:
        return rows.where((F.size("embedding") == dim) & condition).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def read(batches) -> tuple[np.ndarray, np.ndarray]:
        """Ids in their order, and vectors."""
        held = [(b.column(0).to_numpy(), to_matrix(b.column(1), dim)) for b in batches if b.num_rows]
        ids, x = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros((0, dim)))
        order = np.argsort(ids)
        return ids[order], x[order]

    def learn(batches):
        model = fit(read(batches)[1], wanted)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        release_memory()

    # In one task, so that the sample, which has an upper bound, is never the driver's.
    model = pickle.loads(drawn(u < rate).repartition(1).mapInArrow(learn, "model binary").collect()[0]["model"])
    odd = model.parts
    shared = spark.sparkContext.broadcast(model)
    indexed = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("part", T.IntegerType()), T.StructField("deal", T.IntegerType())])

    def by_length(column: pa.ListArray):
        """The rows of each length."""
        lengths = pc.list_value_length(column).to_numpy()
        for n in np.unique(lengths):
            yield int(n), np.flatnonzero(lengths == n)

    def assign(batches):
        seen = 0
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            for n, at in by_length(batch.column(1)):
                part[at] = shared.value.logits(to_matrix(batch.column(1).take(pa.array(at)), n)).argmax(1) if n == dim else odd + n % ODD_PARTITIONS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part), pa.array((seen + np.arange(batch.num_rows)).astype(np.int32))], names=indexed.names)
            seen += batch.num_rows

    index, _ = materialize(rows.mapInArrow(assign, indexed), "ann-index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    ids, q = read(drawn((u >= rate) & (u < rate + CALIBRATION / total)).toArrow().to_batches())
    recall = calibrate(index, model, ids, q, k) if model.parts > 1 and len(ids) else np.array([0.0] * (model.parts - 1) + [1.0])
    probes = int(np.argmax(recall >= target)) + 1 if (recall >= target).any() else model.parts
    if report is not None:
        report |= {"partitions": model.parts, "probes": probes, "recall": float(recall[probes - 1])}
    routed = T.StructType(indexed.fields[:3])

    def route(batches):
        for batch in batches:
            rows, part = [], []
            for n, at in by_length(batch.column(1)):
                if n != dim:
                    rows.append(at), part.append(np.full(len(at), odd + n % ODD_PARTITIONS))
                    continue
                order = shared.value.order(to_matrix(batch.column(1).take(pa.array(at)), n))
                counts = np.array([held.get(p, 0) for p in range(odd)])[order]
                take = ((np.arange(order.shape[1])[None, :] < probes) | (np.cumsum(counts, 1) - counts < k + 1)) & (counts > 0)
                row, which = np.nonzero(take)
                rows.append(at[row]), part.append(order[row, which])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(part).astype(np.int32))], names=routed.names)

    queries, _ = materialize(index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(route, routed), "ann-queries")
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    sizes = spark.createDataFrame([(p, -(-n // BLOCK), -(-asked[p] // BLOCK)) for p, n in sorted(held.items()) if p in asked] or [(-1, 1, 1)], "part int, blocks int, query_blocks int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("vec_id", "deal"), F.col("blocks")).cast("int")).withColumn("query_block", every_block("query_blocks"))
    right = queries.join(F.broadcast(sizes), "part").withColumn("block", every_block("blocks")).withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int"))
    keys = ["part", "block", "query_block"]

    def rerank(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if candidates.num_rows and asked.num_rows:
            ids, qs = candidates["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            vectors, wanted = candidates["embedding"].combine_chunks(), asked["embedding"].combine_chunks()
            of = dict(by_length(vectors))
            for n, at in by_length(wanted):
                if n in of:
                    r, c, d = top_k(qs[at], ids[of[n]], to_matrix(wanted.take(pa.array(at)), n), to_matrix(vectors.take(pa.array(of[n])), n), k)
                    found[0].append(qs[at[r]]), found[1].append(ids[of[n][c]]), found[2].append(d)
            release_memory()
        return pa.table([pa.array(np.concatenate(f)) for f in found], names=out.names)

    columns = ["vec_id", "embedding", *keys]
    found = left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInArrow(rerank, out)
    return nearest_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
