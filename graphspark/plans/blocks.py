"""Values that spread along arcs until none changes, by blocks of arcs: a block's own vertices are settled in one task, without a job for each hop;
only what reaches vertices of other blocks is sent, and a job serves all blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.plans import loop
from graphspark.plans.loop import observed
from graphspark.plans.tables import forget, new_path, shuffles_deleted

#: Arcs of a block, about: what a task holds (some hundred MB with all that it needs of them).
BLOCK_ARCS = 1 << 22
#: Arcs or vertices that a block is sized for at least, whatever the limits are.
LEAST_BLOCK = 16
#: Bytes of a row at most: arrays that are longer take several.
ROW_BYTES = 4 << 20

PACKED = "part int, what string, seq int, n long, data binary"


def packed(part: int, arrays: dict[str, np.ndarray]) -> list[tuple]:
    rows = []
    for what, a in arrays.items():
        step = max(1, ROW_BYTES // max(1, a.itemsize * int(np.prod(a.shape[1:]))))
        rows += [(part, what, seq, len(a[lo : lo + step]), np.ascontiguousarray(a[lo : lo + step]).tobytes()) for seq, lo in enumerate(range(0, max(len(a), 1), step))]
    return rows


def packed_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "what", "seq", "n", "data"])


def unpacked(table: pa.Table, kinds: dict[str, np.dtype]) -> dict[str, np.ndarray]:
    """The arrays of these names; rows of one array are put in their order."""
    found: dict[str, list] = {}
    whats, seqs = table["what"].to_pylist(), table["seq"].to_pylist()
    blobs = [b for chunk in table["data"].chunks for b in chunk]
    for i in sorted(range(len(whats)), key=lambda i: seqs[i]):
        if whats[i] in kinds:
            found.setdefault(whats[i], []).append(np.frombuffer(blobs[i].as_buffer(), kinds[whats[i]]))
    return {k: np.concatenate(v) for k, v in found.items()}


@dataclass(frozen=True)
class Rule:
    """How values spread. A value is a row of `width` numbers; `absent` is what is never sent. extend(values, weights, ids of the senders) gives offers;
    best(a, b) is the better of two values, an associative, commutative and idempotent choice that extend respects, so the result doesn't depend on the order.
    fold(values, starts) is best over runs of rows."""

    dtype: str
    absent: tuple
    extend: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    best: Callable[[np.ndarray, np.ndarray], np.ndarray]
    fold: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Sorts offers of one vertex as fold needs them; none if it doesn't matter.
    keys: Callable[[np.ndarray], tuple] = lambda values: ()
    #: Weights in place of the stored ones, from block; arcs without a positive one are closed. None: all are open.
    weights: Callable[[dict], np.ndarray] | None = None

    @property
    def width(self) -> int:
        return len(self.absent)

    @property
    def message(self) -> np.dtype:
        return np.dtype([("id", "<i8"), ("v", self.dtype, (self.width,))])


def of_ufunc(ufunc, dtype: str, absent, extend, width: int = 1) -> Rule:
    return Rule(dtype, (absent,) * width, extend, ufunc, lambda values, starts: ufunc.reduceat(values, starts, axis=0))


def earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of two (key, tie) rows."""
    return np.where(((b[:, 0] < a[:, 0]) | ((b[:, 0] == a[:, 0]) & (b[:, 1] < a[:, 1])))[:, None], b, a)


FAR = np.iinfo(np.int64).max
#: The least number of hops, from 1 at the start.
LEVEL = of_ufunc(np.minimum, "<i8", FAR, lambda v, w, s: v + 1)
#: The least sum of weights, and the largest least weight.
DISTANCE = of_ufunc(np.minimum, "<f8", np.inf, lambda v, w, s: v + w[:, None])
WIDTH = of_ufunc(np.maximum, "<f8", -np.inf, lambda v, w, s: np.minimum(v, w[:, None]))
#: The smallest value.
SMALLEST = of_ufunc(np.minimum, "<i8", FAR, lambda v, w, s: v)


def bits(n: int) -> Rule:
    """Sets of up to n numbers."""
    return of_ufunc(np.bitwise_or, "<u8", 0, lambda v, w, s: v, -(-n // 64))


def parents(weights: Callable[[dict], np.ndarray]) -> Rule:
    """Hops along open arcs, and the smallest vertex that a shortest path comes from."""
    hop = lambda v, w, s: np.stack([v[:, 0] + 1, s], 1)
    return Rule("<i8", (FAR, FAR), hop, earlier, lambda values, starts: values[starts], lambda values: (values[:, 1], values[:, 0]), weights)


STATIC = {"ids": "<i8", "ptr": "<i8", "dst": "<i4", "w": "<f8", "ends": "<i8", "home": "<i4", "to": "<i4"}


def block_of(part: int, table: pa.Table) -> pa.Table:
    """Arcs (src, dst, to, w) and vertices (src alone) of a block as arrays: its vertices, where each one's arcs start, their ends as places in the list of all ends,
    and of these the place among the block's vertices or else the block that has them."""
    src = table["src"].to_numpy()
    ids = np.unique(src)
    real = table["dst"].is_valid().to_numpy()
    at = np.searchsorted(ids, src[real])
    arcs = table.filter(table["dst"].is_valid())
    del table, src
    order = np.argsort(at, kind="stable")
    ptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ids)))])
    ends, first, place = np.unique(arcs["dst"].to_numpy(), return_index=True, return_inverse=True)
    home = np.minimum(np.searchsorted(ids, ends), len(ids) - 1)
    home = np.where(ids[home] == ends, home, -1)
    out = {"ids": ids, "ptr": ptr, "dst": place[order], "ends": ends, "home": home, "to": arcs["to"].to_numpy()[first]}
    if "w" in arcs.column_names:
        out["w"] = arcs["w"].to_numpy()[order]
    return packed_table(packed(part, {k: a.astype(STATIC[k]) for k, a in out.items()}))


def folded(rule: Rule, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that values have come to, and the best one at each."""
    order = np.lexsort((*rule.keys(values), at)) if rule.keys(values) else np.argsort(at, kind="stable")
    at, values = at[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return (at[starts], rule.fold(values, starts)) if len(at) else (at, values)


def taken(rule: Rule, values: np.ndarray, at: np.ndarray, offers: np.ndarray) -> np.ndarray:
    """Puts better offers, one a place, in the place of values; returns where."""
    new = rule.best(values[at], offers)
    better = (new != values[at]).any(1)
    values[at[better]] = new[better]
    return at[better]


def settle(rule: Rule, b: dict, values: np.ndarray, frontier: np.ndarray, pull: float = 1, everything: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spreads from a frontier until no vertex of the block changes; values are changed in place. Returns ends in other blocks and what they are offered.

    A hop takes the arcs of the frontier (push); if that is more than `pull` of the block's vertices, it looks through all arcs for those that come from it
    (pull). everything: all vertices that have a value send in each hop, not what changed alone."""
    ids, ptr, dst, home = b["ids"], b["ptr"], b["dst"], b["home"]
    w = rule.weights(b) if rule.weights else b.get("w", np.zeros(0))
    offered = np.full((len(b["ends"]), rule.width), rule.absent, rule.dtype)
    outside, sender = np.zeros(len(b["ends"]), bool), None
    while len(frontier):
        if everything:
            frontier = np.flatnonzero((values != np.asarray(rule.absent, rule.dtype)).any(1))
        if len(frontier) > pull * len(ids):
            sender = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ptr)) if sender is None else sender
            active = np.zeros(len(ids), bool)
            active[frontier] = True
            arc = np.flatnonzero(active[sender])
            of = sender[arc]
        else:
            n = ptr[frontier + 1] - ptr[frontier]
            arc = np.repeat(ptr[frontier] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(frontier, n)
        following = []
        for lo in range(0, len(arc), BLOCK_ARCS):  # bounds the arrays
            some, send = arc[lo : lo + BLOCK_ARCS], of[lo : lo + BLOCK_ARCS]
            if rule.weights:
                send, some = send[w[some] > 0], some[w[some] > 0]
            end, best = folded(rule, dst[some], rule.extend(values[send], w[some] if len(w) else w, ids[send]))
            end = taken(rule, offered, end, best)
            at = home[end]
            outside[end[at < 0]] = True
            following.append(taken(rule, values, at[at >= 0], offered[end[at >= 0]]))
        frontier = np.unique(np.concatenate(following)) if following else frontier[:0]
    end = np.flatnonzero(outside)
    return end, offered[end]


class Blocks:
    """Arcs (src, dst and, if weighted, w) and vertices dealt out by vertex, in blocks of BLOCK_ARCS arcs. What is stored is read in each job where it lies."""

    def __init__(self, vertices: DataFrame, arcs: DataFrame, n_arcs: int | None = None, n_vertices: int | None = None, limit: int | None = None, share: int = 1):
        """n_arcs, n_vertices: bounds on how many there are, if known. limit: arcs of a block; share: how many times fewer it gets, for wide values."""
        self.spark = spark = arcs.sparkSession
        n_arcs = arcs.count() if n_arcs is None else n_arcs
        n_vertices = vertices.count() if n_vertices is None else n_vertices
        most = lambda k: max(LEAST_BLOCK, k // share)
        self.n = max(1, -(-n_arcs // most(BLOCK_ARCS if limit is None else limit)), -(-n_vertices // most(loop.WHOLE_ROWS)))
        columns = ["src", "dst", "to"] + ["w"] * ("w" in arcs.columns)
        rows = arcs.withColumn("to", self.part("dst")).withColumn("part", self.part("src")).select("part", *columns)
        lone = vertices.select(self.part("id").alias("part"), F.col("id").alias("src"))
        rows = rows.unionByName(lone, allowMissingColumns=True)

        def build(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
            return block_of(key[0].as_py(), table)

        self.path = new_path(spark, "blocks")
        self.table = "graphspark_" + self.path.rpartition("/")[2].replace("-", "_")
        built = rows.repartition(self.n, "part").groupBy("part").applyInArrow(build, PACKED)
        with shuffles_deleted(spark):
            built.write.format("parquet").bucketBy(self.n, "part").sortBy("part").option("path", self.path).option("compression", "lz4").saveAsTable(self.table)
        self.static = spark.table(self.table)

    def part(self, column: str) -> Column:
        """The block of a vertex: one of n numbers that Spark deals to n different tasks."""
        at = F.pmod(F.xxhash64(column), F.lit(self.n)).cast("int")
        return F.element_at(F.lit(task_keys(self.spark, self.n)), at + 1) if self.n > 1 else F.lit(0)

    def spread(self, rule: Rule, start: DataFrame | None, own: bool = False, **options) -> DataFrame:
        """part, what, ... of the values that no further step changes. start(id, value): what is known at first, a number each, or of bits the place of one; own: each vertex has
        its id. A job for each step in which blocks have sent to each other; options are those of settle."""
        width, message = rule.width, rule.message
        single = rule.dtype != "<u8"

        def first(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
            rows, value = np.zeros(table.num_rows, message), table["value"].to_numpy()
            rows["id"] = table["id"].to_numpy()
            if single:
                rows["v"] = np.asarray(rule.absent, rule.dtype)
                rows["v"][:, 0] = value
            else:
                rows["v"][np.arange(len(rows)), value // 64] = np.uint64(1) << (value % 64).astype(np.uint64)
            return packed_table(packed(key[0].as_py(), {"messages": rows}))

        def step(key: tuple[pa.Scalar], left: pa.Table, right: pa.Table) -> pa.Table:
            part = key[0].as_py()
            state = unpacked(right, {"values": np.dtype(rule.dtype), "messages": message})
            got, had = state.get("messages"), "values" in state
            if (got is None or not len(got)) and had:
                return right
            b = unpacked(left, STATIC)
            ids = b["ids"]
            if had:
                values = state["values"].reshape(-1, width).copy()
            else:
                values = np.full((len(ids), width), rule.absent, rule.dtype)
            frontier = np.zeros(0, np.int64)
            if own and not had:
                values[:, 0], frontier = ids, np.arange(len(ids))
            if got is not None and len(got) and len(ids):
                at = np.minimum(np.searchsorted(ids, got["id"]), len(ids) - 1)
                known = ids[at] == got["id"]
                at, best = folded(rule, at[known], got["v"][known].reshape(-1, width))
                frontier = np.union1d(frontier, taken(rule, values, at, best))
            rows = []
            if len(frontier):
                end, offers = settle(rule, b, values, frontier, **options)
                to = b["to"][end]
                for p in np.unique(to):
                    out = np.zeros((to == p).sum(), message)
                    out["id"], out["v"] = b["ends"][end[to == p]], offers[to == p]
                    rows += packed(int(p), {"messages": out})
            return packed_table(rows + packed(part, {"values": values}))

        dynamic = start.withColumn("part", self.part("id")).groupBy("part").applyInArrow(first, PACKED) if start is not None else self.spark.createDataFrame([], PACKED)
        state = path = None
        while True:
            dealt = dynamic.repartition(self.n, "part")
            out = self.static.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(step, PACKED)
            state, new_path, seen = observed(out, "spread", sent=F.sum(F.when(F.col("what") == "messages", F.col("n"))))
            if path:
                forget(self.spark, path)
            path, dynamic = new_path, state
            if not seen["sent"]:
                return state

    def read(self, state: DataFrame, rule: Rule, schema: str, rows: Callable[[np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
        """rows(ids, values) of each block."""

        def values(key: tuple[pa.Scalar], left: pa.Table, right: pa.Table) -> pa.Table:
            found = unpacked(right, {"values": np.dtype(rule.dtype)})["values"].reshape(-1, rule.width)
            return rows(unpacked(left, {"ids": STATIC["ids"]})["ids"], found)

        ids = self.static.where("what = 'ids'")
        return ids.groupBy("part").cogroup(state.where("what = 'values'").groupBy("part")).applyInArrow(values, schema)

    def spread_values(self, rule: Rule, start: DataFrame | None, own: bool = False, kind: str = "long", **options) -> DataFrame:
        """id, value (or value and tie) of the vertices that a value reaches."""
        names = ["value", "tie"][: rule.width]

        def rows(ids: np.ndarray, values: np.ndarray) -> pa.Table:
            some = (values != np.asarray(rule.absent, rule.dtype)).any(1)
            return pa.table([pa.array(ids[some]), *[pa.array(np.ascontiguousarray(values[some, i])) for i in range(rule.width)]], names=["id", *names])

        return self.read(self.spread(rule, start, own, **options), rule, ", ".join(["id long"] + [f"{c} {kind}" for c in names]), rows)


_KEYS: dict[int, list[int]] = {}


def task_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a shuffle to n tasks deals to a different one each."""
    if n not in _KEYS:
        found: dict[int, int] = {}
        size = 32 * n
        while len(found) < n:
            rows = spark.range(size).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task")).agg(F.min("id").alias("key")).collect()
            found, size = {r["task"]: r["key"] for r in rows}, size * 4
        _KEYS[n] = [found[i] for i in range(n)]
    return _KEYS[n]
