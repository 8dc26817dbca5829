"""Similarity self-join of word-shingle sets by chosen paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import PACKED, Seen, among, bound_batches, buffers, byte_values, cell_filter, forget, join_groups, materialize, minhash, mix, pack_arrays, packed_batch, passes, range_hashes, release_memory, split_by, to_part, word_pieces, word_spans
from graphspark.llm.components import BLOCK, CONNECT_BLOCK, comparison_rows, connected_components, exact_links, with_sizes

SHINGLE = 5
SIMILARITY = 0.8
#: Independent runs, each from a chosen token of its own. A path of d tokens keeps a pair of similarity s with
#: probability s**d, so these runs miss a pair at 0.8 with probability (1 - 0.8**d)**RUNS: 2e-8 for two tokens, 2e-5 for three.
RUNS = 16
#: Tokens of a sketch; a byte of each is kept for the estimates and for the paths beyond the first token.
TOKENS = 64
#: Pairs estimated below this are dropped before the exact comparison: four deviations of the estimate under 0.8.
ESTIMATE = 0.6
#: Buckets of up to this many sets are compared pairwise; larger ones are split on another token.
BRUTE = 256
#: A larger bucket is compared at once too if so many of its sets are similar to one of them: it is one component, or nearly.
DENSE = 0.9
MAX_DEPTH = 8
#: A bucket with more is split on further tokens of its path before it is sent.
HOT = 20_000
#: Tokens by which paths are extended so at most; SHARE of a bucket's sets in one part of it says that its sets are so similar
#: that more tokens wouldn't split it. Such a bucket is dealt into blocks, and each two of them meet.
MAX_EXTENSIONS = 8
SHARE = 0.75
#: Cells in which the buckets' sizes are counted; this bounds what is sent to the executors.
CELLS = 1 << 14
#: Sets of a group: what a task compares at once.
GROUP_SETS = 1 << 17
FLUSH = 1 << 14
#: Bytes of sets that a task gathers before it passes them on.
FLUSH_SETS = 8 << 20


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every row, and how many each has: SHINGLE words in a row; a row of fewer words is one
    shingle, a row without words has none."""
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    begin = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    stop = np.minimum(begin + SHINGLE, np.repeat(first[1:], counts))
    return range_hashes(words, begin, stop, 0x27BB2EE687B0B0FD), counts


def shingles_of(column: pa.Array):
    """For pieces of a column: first row, shingle hashes, and how many each row has. A very long text comes in pieces that overlap."""
    offsets, raw = buffers(column)
    for lo, part, off, before in word_pieces(raw, offsets, SHINGLE - 1):
        starts, ends, first = word_spans(part, off)
        h, counts = shingle_hashes(range_hashes(byte_values()[part], starts, ends, 0x5851F42D4C957F2D), first)
        yield lo, h, counts, before


def sketches(column: pa.Array):
    """First rows, which rows have words, and their minima."""
    held = None  # of a long text whose pieces aren't all seen
    for lo, h, counts, before in shingles_of(column):
        if held is not None and not before:
            yield held
            held = None
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        minima = minhash(h, (np.cumsum(counts) - counts)[some], TOKENS)
        if before:
            held = lo, some, np.minimum(held[2], minima)
        elif len(counts) == 1:
            held = lo, some, minima
        else:
            yield lo, some, minima
    if held is not None:
        yield held


def sets_of(column: pa.Array, wanted: np.ndarray):
    """First rows, rows, and the sorted set of shingle hashes of each wanted row with words."""
    held, row = [], -1
    for lo, h, counts, before in shingles_of(column):
        if held and not before:
            yield row, np.unique(np.concatenate(held))
            held = []
        stop = np.cumsum(counts)
        for i in np.flatnonzero((counts > 0) & wanted[lo : lo + len(counts)]):
            own = np.unique(h[stop[i] - counts[i] : stop[i]])
            if len(counts) == 1:  # it may be a piece
                held.append(own)
                row = lo
            else:
                yield lo + int(i), own
    if held:
        yield row, np.unique(np.concatenate(held))


def to_bytes(minima: np.ndarray) -> np.ndarray:
    return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def first_keys(minima: np.ndarray) -> np.ndarray:
    """(rows, RUNS): the bucket of each run's first token."""
    return np.stack([mix(minima[:, r].astype(np.uint64) + np.uint64((r + 1) << 32)) for r in range(RUNS)], 1)


def linked(sketch: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which rows of sketch may be similar to the row `to`: a byte agrees by chance once in 256."""
    return (sketch == to).mean(1) >= ESTIMATE


def split(sketch: np.ndarray, at: np.ndarray, path: int, depth: int, out: list) -> None:
    """The bucket `at` (rows of sketch), reached by a path of tokens. A small one is compared; a larger one is split on a
    token that a hash of the path chooses. Adds rows (member, a row of the component that it is linked with); pairs that
    are connected through these aren't compared again."""
    if len(at) < 2:
        return
    if len(at) > BRUTE and depth < MAX_DEPTH and linked(sketch[at], sketch[at[0]]).mean() < DENSE:
        first = int(mix(np.array([path], np.uint64))[0] % np.uint64(TOKENS - RUNS))
        for token in (RUNS + (first + k) % (TOKENS - RUNS) for k in range(TOKENS - RUNS)):
            values = sketch[at, token]
            if (values == values[0]).all():  # of the path already, or of a passage that all share
                continue
            for v in np.unique(values):
                split(sketch, at[values == v], (path * 1000003 + token * 257 + int(v) + 1) & ((1 << 63) - 1), depth + 1, out)
            return
    # Brute force around pivots: what a pivot is linked with is one component already, so only its pairs with the others are compared.
    rest = at
    groups: list[np.ndarray] = []
    while len(rest):
        near = linked(sketch[rest], sketch[rest[0]])
        near[0] = True
        group, rest = rest[near], rest[~near]
        groups.append(group)
        for member in group[1:]:
            out.append((member, group[0]))
        for other in rest if len(group) > 1 else ():
            if linked(sketch[group[1:]], sketch[other]).any():
                out.append((other, group[0]))


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, ids, rows = [], [], []
    for blob in table["data"]:
        blob = blob.as_buffer()
        n = len(blob) // (16 + TOKENS)
        keys.append(np.frombuffer(blob, "u8", n)), ids.append(np.frombuffer(blob, "i8", n, 8 * n)), rows.append(np.frombuffer(blob, "u1", n * TOKENS, 16 * n).reshape(n, TOKENS))
    return np.concatenate(keys), np.concatenate(ids), np.concatenate(rows)


def meet(table: pa.Table) -> pa.Table:
    """Links (a, b) within the buckets of a group. A set that several tasks have sent counts once."""
    key, ids, rows = unpack(table)
    order = np.lexsort((ids, key))
    again = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (ids[order][1:] == ids[order][:-1])])
    order = order[~again]
    key = key[order]
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    found: list[tuple[int, int]] = []
    for start, at in zip(key[[0, *cuts]] if len(key) else (), np.split(order, cuts)):
        if len(at) > 1:
            split(rows, at, int(start) & ((1 << 62) - 1), 1, found)
    pairs = np.unique(ids[np.array(found, np.int64).reshape(-1, 2)], axis=0)
    return pa.table([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def sketch_table(sets: DataFrame) -> DataFrame:
    """id, data: the minima of the first RUNS tokens and the sketch of each different set with words. A text that a task has met
    before is passed on once, and what several tasks pass on meets by id."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            names, data = [], []
            for lo, some, minima in sketches(batch.column(1)):
                at = np.flatnonzero(seen.new(ids[lo + some]))
                names.append(ids[lo + some[at]])
                data += map(bytes, np.concatenate([np.ascontiguousarray(minima[at, :RUNS]).view(np.uint8), to_bytes(minima[at])], 1))
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(data, pa.binary())], names=["id", "data"])
        release_memory()

    return sets.mapInArrow(run, "id long, data binary").groupBy("id").agg(F.first("data").alias("data"))


def read_sketches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, minima of the first RUNS tokens, and sketches of rows that sketch_table() made."""
    raw = buffers(batch.column(1))[1].reshape(batch.num_rows, 4 * RUNS + TOKENS)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(raw[:, : 4 * RUNS]).view(np.uint32), raw[:, 4 * RUNS :]


def digest_halves(text) -> tuple:
    """Two halves, as 64-bit numbers, of 128 bits of a text's SHA-256."""
    digest = F.sha2(text.cast("binary"), 256)
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def path_keys(minima: np.ndarray, sketch: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, RUNS): the bucket of each run's path, and the bucket that it was a part of before the last extension. levels: the
    buckets (sorted) that are split on a further token, those of the first tokens first. The first token chooses the others."""
    keys = first_keys(minima)
    start, parents = keys % np.uint64(TOKENS - RUNS), np.zeros_like(keys)
    for depth, wide in enumerate(levels):
        row, run = np.nonzero(among(keys, wide))
        token = RUNS + (start[row, run].astype(np.int64) + 11 * depth) % (TOKENS - RUNS)  # 11 and 48 have no common factor: no token twice
        parents[:] = 0
        parents[row, run] = keys[row, run]
        keys[row, run] = mix(keys[row, run] * np.uint64(1000003) + sketch[row, token] + np.uint64(1))
    return keys, parents


def wide_buckets(sketched: DataFrame, n: int) -> tuple[list[np.ndarray], dict[int, int]]:
    """Buckets of more than HOT sets: those to be split on a further token, by the length of their paths, and those that further
    tokens don't split, with their sizes. Of both there are RUNS * n / HOT at most, at each length."""
    if n <= HOT:  # a bucket can only hold more than HOT sets if there are as many
        return [], {}

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(to_part(first_keys(read_sketches(batch)[1]).ravel(), CELLS), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    average = n * RUNS // CELLS
    cells = np.zeros(CELLS, bool)
    cells[[r["cell"] for r in sketched.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > HOT + average).collect()]] = True
    if not cells.any():
        return [], {}

    def sizes(levels: list[np.ndarray]) -> list[tuple[int, int, int]]:
        def run(batches):
            for batch in batches:
                _, minima, sketch = read_sketches(batch)
                keys, parents = path_keys(minima, sketch, levels)
                at = parents > 0 if levels else cells[to_part(keys.ravel(), CELLS)].reshape(keys.shape)
                key, first, times = np.unique(keys[at], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (parents[at][first].view(np.int64), key.view(np.int64), times)], names=["parent", "key", "n"])

        found = sketched.mapInArrow(run, "parent long, key long, n long").groupBy("parent", "key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).collect()
        return [(r["parent"] & (2**64 - 1), r["key"] & (2**64 - 1), r["n"]) for r in found]

    levels, dense = [], {}
    wide = {key: size for _, key, size in sizes(levels)}
    while wide and len(levels) < MAX_EXTENSIONS:
        below = sizes([*levels, np.array(sorted(wide), np.uint64)])
        whole = {parent for parent, _, size in below if size > SHARE * wide[parent]}
        dense |= {key: wide[key] for key in whole}
        levels.append(np.array(sorted(wide.keys() - whole), np.uint64))
        wide = {key: size for parent, key, size in below if parent not in whole}
    return levels, dense | wide


def candidate_edges(sketched: DataFrame, n: int) -> DataFrame:
    """a, b of pairs that may be similar. sketched: as sketch_table() gives it, each set once, so that copies neither are sent nor
    make a bucket large; n: how many sets there are."""
    levels, dense = wide_buckets(sketched, n)
    blocked = np.array(sorted(dense), np.uint64)
    blocks = np.array([max(2, -(-2 * dense[int(k)] // HOT)) for k in blocked], np.int64)
    parts = max(8, (n * RUNS + sum(dense[int(k)] * (int(b) - 2) for k, b in zip(blocked, blocks))) // GROUP_SETS)

    def send(batches):
        gathered, waiting = [], 0

        def flush():
            key, ids, rows = (np.concatenate(c) for c in zip(*gathered))
            out = [(p, pack_arrays(k, i) + np.ascontiguousarray(r).tobytes()) for p, k, i, r in split_by(to_part(key, parts), key, ids, rows)]
            for lo in range(0, len(out), 256):
                yield packed_batch(out[lo : lo + 256])

        for batch in batches:
            mine, minima, sketch = read_sketches(batch)
            key, at = path_keys(minima, sketch, levels)[0].ravel(), np.repeat(np.arange(len(mine)), RUNS)
            some = among(key, blocked)
            if some.any():
                # A set is in one block of its bucket and goes wherever that block meets another.
                k, who = key[some], at[some]
                of = blocks[np.searchsorted(blocked, k)]
                own = (mix(mine[who].astype(np.uint64) + np.uint64(17)) % of.astype(np.uint64)).astype(np.int64)
                k, who, own = (np.repeat(c, of - 1) for c in (k, who, own))
                other = np.arange(len(k)) - np.repeat(np.cumsum(of - 1) - (of - 1), of - 1)
                other += other >= own
                pair = np.minimum(own, other).astype(np.uint64) << np.uint64(32) | np.maximum(own, other).astype(np.uint64)
                key, at = np.concatenate([key[~some], mix(k ^ mix(pair))]), np.concatenate([at[~some], who])
            gathered.append((key, mine[at], sketch[at]))
            waiting += len(key)
            if waiting >= FLUSH * RUNS:
                yield from flush()
                gathered, waiting = [], 0
        if waiting:
            yield from flush()
        release_memory()

    return sketched.mapInArrow(send, PACKED).groupBy("part").applyInArrow(meet, "a long, b long")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, count_links: bool = True) -> DataFrame:
    """One row per row of docs, without its text: all other columns, and class_id, n_links, n_copies. Without count_links there is no n_links;
    the classes are the same, but pairs that are connected already needn't be compared.

    Sets are the shingles of SHINGLE words; two are linked if their exact Jaccard similarity is at least `similarity`.
    class_id is the smallest id that links lead to; n_links counts the other rows linked directly, copies of equal text
    included; n_copies the rows of equal text.

    1. Equal texts are one set: equal in 128 bits of the SHA-256. Its name is the first half of these, or the second half where different
    texts agree in the first; there are about n^2 / 2^65 such names for n texts (one in 6e9 texts, 270 in 1e11). 2. In each of RUNS runs the sets are put in buckets
    by a token of their own (a minimum of hashes); a bucket is split on further tokens until it is small, then its sets
    are compared by sketches. Buckets too large for a task are split so before they are sent; what tokens don't split is
    sent in blocks, each two of which meet. 3. Components of the links found so are candidates: their sets are compared exactly, each
    pair once. 4. Components of the exact links are the classes.
    Edge cases: texts without words have no links and are classes of their own, copies of each other as they may be. A
    text of fewer words than a shingle is one shingle. A null id never is the smallest. Rows that repeat are copies. An
    empty table gives an empty table. Columns named like the results are replaced."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop("class_id", "n_links", "n_copies")
    text = F.coalesce(F.col(text_col), F.lit(""))
    half, other = digest_halves(text)
    halves = docs.select(id_col, half.alias("__half"), other.alias("__other"), text.rlike(r"[^\x20\x09-\x0D]").alias("__words"))
    groups, _ = materialize(halves.groupBy("__half", "__other").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("__words").alias("__words")), "jaccard-sets")
    clashes = [r["__half"] for r in groups.groupBy("__half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__half").collect()]

    def name(half, other):
        return F.when(half.isin(clashes), other).otherwise(half) if clashes else half

    groups = groups.withColumn("__set", name(F.col("__half"), F.col("__other"))).drop("__half", "__other")
    sets = docs.select(name(half, other).alias("id"), text.alias("text"))
    narrow = docs.withColumn("__set", name(half, other)).withColumn("__words", text.rlike(r"[^\x20\x09-\x0D]")).drop(text_col)
    sketched, sketch_path = materialize(sketch_table(sets), "jaccard-sketches")
    edges = candidate_edges(sketched, groups.count())
    sized, _ = materialize(with_sizes(connected_components(edges, "a", "b")), "jaccard-candidates")
    forget(spark, sketch_path)
    sized = sized.join(groups.select(F.col("__set").alias("id"), F.col("n_copies").alias("weight")), "id")
    wanted = spark.sparkContext.broadcast(cell_filter(sized, "id"))

    def content(batches):
        seen = Seen()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = passes(wanted.value, ids)
            keep[keep] = seen.new(ids[keep])
            rows, data, size = [], [], 0
            for i, own in sets_of(batch.column(1), keep):
                rows.append(i), data.append(own.tobytes())
                size += len(data[-1])
                if size > FLUSH_SETS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(data, pa.binary())], names=["id", "data"])
                    rows, data, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(data, pa.binary())], names=["id", "data"])
        release_memory()

    members = sets.mapInArrow(content, "id long, data binary").join(sized, "id").groupBy("root", "members", "id", "weight").agg(F.first("data").alias("data"))
    links, _ = materialize(exact_links(members, comparison_rows(sized, BLOCK if count_links else CONNECT_BLOCK), lambda column: [np.frombuffer(x.as_buffer(), "u8") for x in column], similarity, count_links), "jaccard-links")
    roots, _ = materialize(connected_components(links, "id", "other"), "jaccard-classes")
    classes = roots.join(groups, roots["id"] == groups["__set"]).select("id", "root", "rep")
    smallest = classes.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("members"))
    classes = join_groups(classes, smallest, "root", "members", F.xxhash64("root", "id")).select("id", "class_id")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = groups.join(classes.join(counts, "id").withColumnRenamed("id", "__set"), "__set", "left")
    found = found.select("__set", "n_copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    joined = join_groups(narrow.drop("n_copies"), found, "__set", "n_copies", F.xxhash64(F.col(id_col).cast("string"), F.col("__set")))
    joined = joined.withColumn("class_id", F.when(F.col("__words"), F.col("class_id")).otherwise(F.col(id_col))).withColumn("n_links", F.when(F.col("__words"), F.col("n_links")).otherwise(0).cast("long"))
    return joined.drop("__set", "__words", *([] if count_links else ["n_links"]))


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k + 1, k + 5), ' ') AS s FROM d, unnest(range(0, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) t(k)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(id, class_id) USING KEY (id) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.y, min(c.class_id) FROM c JOIN u ON u.x = c.id JOIN recurring.c r ON r.id = u.y GROUP BY u.y HAVING min(c.class_id) < min(r.class_id)),
k AS (SELECT x, count(*) AS n FROM u GROUP BY 1)
SELECT d.doc_id, c.class_id, coalesce(k.n, 0)::BIGINT AS n_links, count(*) OVER (PARTITION BY coalesce(d.text, '')) AS n_copies
FROM d JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""
