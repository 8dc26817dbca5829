"""Distributed union-find, and exact links within candidate components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import forget, join_groups, materialize, shuffles_deleted

#: Members of a component that are compared in one piece; larger components are compared in pairs of blocks.
BLOCK = 512
#: The same where only who is connected counts: most pairs then cost a comparison of bitmaps.
CONNECT_BLOCK = 2048
#: Members that a part of the packed comparison holds, about.
PART_ROWS = 4096
#: Bits of a bitmap, and members from which bitmaps pay.
BITS, BITMAP_MEMBERS = 1024, 32
#: Bytes of data whose sets a comparison holds at once, but for a single piece of more.
SET_DATA = 2 << 20


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, root (the smallest id of the component) of every id with an edge to another.

    Alternates two rounds until the edges are stars: each id links its larger neighbours to its smallest one, then each
    id links its smaller neighbours and itself to the smallest. Both are a grouped minimum, which is partly done before
    the shuffle, and a join in which the largest groups' minima are broadcast, a fixed number of rows, so that no id with very many
    neighbours is one task's. Each round is written to the shared folder, so lineage stays short and a lost executor costs a round at most."""
    spark = edges.sparkSession
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    current, path = materialize(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "components")

    def joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return join_groups(rows, groups, "u", "n", F.xxhash64("u", "v"))

    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined(both.where("v > u"), smallest).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = materialize(small, "components")
        ends = new.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(new.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        open_ids = ends.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)")
        with shuffles_deleted(spark):
            done = open_ids.isEmpty()
        forget(spark, path)
        current, path = new, new_path
        if done:
            roots = current.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
            return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def with_sizes(components: DataFrame) -> DataFrame:
    return join_groups(components, components.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root", "members", F.xxhash64("root", "id"))


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index of each row's component, from a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a product of incidence matrices in slices."""
    n = len(sets)
    if n == 2:
        return np.array([[0, 1], [1, 0]], np.float32) * len(np.intersect1d(*sets, assume_unique=True))
    sizes = np.array([len(s) for s in sets])
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = counts[inverse] > 1
    code = np.cumsum(counts > 1) - 1
    row, col = row[shared], code[inverse[shared]]
    out = np.zeros((n, n), np.float32)
    width = max(1, (4 << 20) // n)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(col, lo), np.searchsorted(col, lo + width)
        m = np.zeros((n, min(width, int(code[-1]) + 1 - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def parity_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of how many of its hashes fall on each of BITS bits. Two bitmaps differ in no more bits than the sets do in
    elements, so they bound a similarity from above."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) % BITS
    odd = np.bincount(row * BITS + bit, minlength=len(sets) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), BITS), axis=1).view(np.uint64)


def shared_with(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    sizes = np.array([len(s) for s in others])
    return np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)


def connected(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """The smallest index of each row's component in the graph of all pairs of (non-empty) sets with a Jaccard similarity of num / den at
    least; side: only pairs of different sides are looked at.

    No pair is left out but those that are connected already, and those whose sizes or bitmaps show that they aren't similar enough."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    size, bitmap, label = sizes[order], parity_bitmaps(sets)[order], order.copy()
    side = None if side is None else side[order]
    ends = np.searchsorted(size, size * den // num, "right")
    for x, end in enumerate(ends.tolist()):
        at = x + 1 + np.flatnonzero(label[x + 1 : end] != label[x])
        if side is not None:
            at = at[side[at] != side[x]]
        if not len(at):
            continue
        apart = np.bitwise_count(bitmap[at] ^ bitmap[x]).sum(1, dtype=np.int64)
        at = at[apart * (den + num) <= (den - num) * (size[at] + size[x])]
        for lo in range(0, len(at), 256):
            some = at[lo : lo + 256]
            some = some[label[some] != label[x]]
            if len(some):
                both = shared_with(sets[order[x]], [sets[k] for k in order[some]])
                met = np.unique(label[some[den * both >= num * (size[some] + size[x] - both)]])
                if len(met):
                    label[np.isin(label, met) | (label == label[x])] = min(met[0], label[x])
    out = np.empty_like(label)
    out[order] = label
    return out


def comparison_rows(sized: DataFrame, block: int = BLOCK) -> int:
    """Rows that exact_links deals out for these ids."""
    return sized.agg(F.sum(F.ceil(F.col("members") / block)).alias("n")).first()["n"] or 0


def exact_links(members: DataFrame, rows: int, to_sets, similarity: float, counted: bool = True) -> DataFrame:
    """members(root, members, id, weight, data): candidates by component. Yields rows id, other, links: `other` connects
    id with its links in one comparison, links is the weight of those whose Jaccard similarity is high enough.

    rows: as comparison_rows counts them. to_sets turns a column of data into sorted sets of hashes. A component of up to BLOCK members is compared in one
    piece, a larger one in pairs of blocks that its members are dealt into by a hash, so each pair is compared once and no
    task holds a component; what leaves a comparison is at most a row for each member. If links needn't be counted (counted; they are null then, and rows are of
    blocks of CONNECT_BLOCK), pairs that are connected already aren't compared again, and bitmaps rule out most others."""
    per = F.ceil(F.col("members") / (BLOCK if counted else CONNECT_BLOCK))
    parts = max(64, -(-rows // PART_ROWS))
    placed = members.withColumn("blocks", per.cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "weight", "data")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts)).cast("int"))
    num, den = int(round(similarity * 100)), 100

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        root, i, j, own, ids, weight = (table[c].to_numpy() for c in ("root", "i", "j", "own", "id", "weight"))
        order = np.lexsort((ids, j, i, root))
        change = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        data = table["data"].combine_chunks()
        before = np.concatenate([[0], np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)[order])])
        cuts = np.concatenate([[0], change, [len(order)]])
        found = [], [], []
        lo = 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(before[cuts], before[cuts[lo]] + SET_DATA, "right")) - 1)
            sets = to_sets(data.take(pa.array(order[cuts[lo] : cuts[hi]])))
            for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1]):
                at, mine = order[a:b], sets[a - cuts[lo] : b - cuts[lo]]
                if len(at) < 2:
                    continue
                across = i[at[0]] != j[at[0]]
                if not counted and len(at) >= BITMAP_MEMBERS:
                    label = connected(mine, own[at] if across else None, num, den)
                    some = np.bincount(label, minlength=len(at))[label] > 1
                    found[0].append(ids[at][some]), found[1].append(ids[at][label[some]]), found[2].append(np.zeros(some.sum(), np.int64))
                    continue
                size = np.array([len(s) for s in mine], np.float64)
                both = overlaps(mine)
                linked = (both > 0) & (den * both >= num * (size[:, None] + size[None, :] - both))
                np.fill_diagonal(linked, False)
                if across:
                    linked &= own[at][:, None] != own[at][None, :]
                some = linked.any(1)
                if some.any():
                    label = local_roots(linked)
                    found[0].append(ids[at][some]), found[1].append(ids[at][label[some]]), found[2].append((linked @ weight[at])[some].astype(np.int64))
            lo = hi
        cols = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]
        return pa.table([*map(pa.array, cols[:2]), pa.array(cols[2]) if counted else pa.nulls(len(cols[2]), pa.int64())], names=["id", "other", "links"])

    return placed.groupBy("part").applyInArrow(compare, "id long, other long, links long")
