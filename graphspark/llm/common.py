"""What the operators share: tables written to the shared folder, and hashing of words, lines and shingles on Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels, so that their arrays stay in cache; a longer document is handled alone.
CHUNK_BYTES = 1 << 17
#: Words: runs of anything but these bytes (space, tab, line feed, vertical tab, form feed, carriage return).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where it is unset, only one machine may take a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="graphspark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Deletes the shuffle files of an execution as soon as it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files: nothing reads them again, as its lineage ends in the table."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: its lineage ends there. Returns the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that materialize() wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows and bytes of an Arrow batch at most: what a Python worker, and the JVM beside it, hold of a partition at once.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to ours; a lower limit stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Gives what a finished task has freed back to the system: Python workers live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of text in the whole table; sizes partitions."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first()["n"] or 0


def held_out(id_col: str):
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def new_name(columns: list[str]) -> str:
    """A name that none of the columns has."""
    return "text_" + "_" * max(map(len, columns), default=0)


def spread_id(id_col: str, text_col: str):
    """The id as a number; null ids come after the others and are spread by a hash of their text, so that they don't meet in one place."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 62)))


#: Groups that join_groups broadcasts: the largest ones, and never more.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread, dealt: str | None = None) -> DataFrame:
    """rows with the columns of their group, null where there is none; groups has one row for each key.

    The HOT_GROUPS largest groups are broadcast, and their rows then go to the other join under `spread`, a value of the
    key's type that differs from row to row; so no key of that join has more than one in HOT_GROUPS of the rows. dealt: a column that keeps what they were dealt by."""
    columns = [c for c in groups.columns if c != key]
    hot = groups.orderBy(F.desc(size), key).limit(HOT_GROUPS).select(key, *[F.col(c).alias(f"__hot_{c}") for c in columns], F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("__join", F.when(F.col("__hot"), spread).otherwise(F.col(key)))
    joined = marked.join(groups.withColumnRenamed(key, "__join"), "__join", "left")
    return joined.withColumns({c: F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)) for c in columns}).withColumnsRenamed({"__join": dealt} if dealt else {}).drop("__join", "__hot", *[f"__hot_{c}" for c in columns])


# --- Arrow buffers -------------------------------------------------------------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of about limit bytes; one longer row makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor, shift, multiply), in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


@functools.cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n at least; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 64 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range, in time that doesn't depend on their lengths."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of all rows, and how many words start before each row (one more entry than rows)."""
    solid = np.zeros(len(raw) + 1, bool)
    np.logical_not(_SPACE[raw], out=solid[:-1])
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins = solid[:-1].copy()
    begins[1:] &= ~solid[:-2]
    begins[first] = solid[first]
    stops = solid[:-1] & ~solid[1:]
    cut = first[first > 0] - 1
    stops[cut] = solid[cut]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_pieces(raw: np.ndarray, offsets: np.ndarray, overlap: int, limit: int = CHUNK_BYTES):
    """Rows in pieces of about limit bytes: first row, bytes, offsets, and how many words of the row come before.

    A longer row is cut between words into pieces of its own, each of which begins with the last `overlap` words of the
    one before, so that every sequence of overlap + 1 words lies in exactly one piece."""
    for lo, hi in chunks(offsets, limit):
        at, end = int(offsets[lo]), int(offsets[hi])
        if end - at <= 2 * limit:
            yield lo, raw[at:end], offsets[lo : hi + 1] - at, 0
            continue
        while end > at and _SPACE[raw[end - 1]]:
            end -= 1
        before = 0
        while at < end:
            size = limit
            while True:
                stop = min(at + size, end)
                while stop < end and not _SPACE[raw[stop]]:  # on to the end of a word
                    gap = np.flatnonzero(_SPACE[raw[stop : stop + 4096]])
                    stop = min(end, stop + (int(gap[0]) if len(gap) else 4096))
                starts, _, _ = word_spans(raw[at:stop], np.array([0, stop - at]))
                if stop == end or len(starts) > overlap:
                    break
                size *= 2
            yield lo, raw[at:stop], np.array([0, stop - at]), before
            if stop == end:
                break
            step = len(starts) - overlap
            before += step
            at = at + int(starts[step]) if overlap else stop


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, and the index of each row's first word."""
    starts, ends, first = word_spans(raw, offsets)
    return range_hashes(byte_values()[raw], starts, ends, 0x5851F42D4C957F2D), first


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every window of size words that lies in one row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first[:-1][row] + place
    return range_hashes(words, starts, starts + size, 0x27BB2EE687B0B0FD), row, place


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the keys are some of these, which are sorted."""
    if not len(some):
        return np.zeros(keys.shape, bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


class Seen:
    """What a task has met lately, so that repeats are passed on once: forgetting costs repeats, never rows."""

    def __init__(self, most: int = 1 << 18):
        self.names: set[int] = set()
        self.most = most

    def new(self, names: np.ndarray) -> np.ndarray:
        """Which of the names weren't met before; only the first of equal ones is."""
        if len(self.names) > self.most:
            self.names.clear()
        out = np.zeros(len(names), bool)
        for i, name in enumerate(names.tolist()):
            if name not in self.names:
                self.names.add(name)
                out[i] = True
        return out


# --- Packed rows: arrays as one binary value, so that a shuffle moves few rows -------------------------------


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other; their types are known to the reader."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack_arrays(blobs, kinds: list[str]) -> list[np.ndarray]:
    """Concatenates the arrays of all blobs that pack_arrays made."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for i, k in enumerate(kinds):
            parts[i].append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def split_by(part: np.ndarray, *arrays: np.ndarray):
    """Yields each value of part with its rows of the arrays, in their order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    sorted_arrays = [a[order] for a in arrays]
    for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
        yield int(part[lo]), *(a[lo:hi] for a in sorted_arrays)


def to_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Deals 64-bit hashes into parts by their upper bits."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


PACKED = "part int, data binary"


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])


# --- MinHash, lines, bounded filters ---------------------------------------------------------------------------


@functools.cache
def minhash_parameters(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2019)
    return rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32), rng.integers(0, 1 << 31, k, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) minima of k permutations of the upper halves of hashes; starts: first hash of each row, none empty."""
    flips, factors = minhash_parameters(k)
    low, v = (h >> np.uint64(32)).astype(np.uint32), np.empty(len(h), np.uint32)
    out = np.empty((len(starts), k), np.uint32)
    for j in range(k):
        np.bitwise_xor(low, flips[j], out=v)
        np.multiply(v, factors[j], out=v)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def row_sets(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each row."""
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])] if len(counts) else []


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, row and number in its row of every line that isn't blank, without white space at its ends."""
    breaks = np.flatnonzero(raw == 10)
    per_row = 1 + np.diff(np.searchsorted(breaks, offsets))
    last = np.cumsum(per_row) - 1
    n = int(per_row.sum())
    starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    inner = np.ones(n, bool)
    inner[last - per_row + 1] = False
    starts[~inner], starts[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[last] = False
    ends[~inner], ends[inner] = offsets[1:], breaks
    row = np.repeat(np.arange(len(per_row)), per_row)
    number = np.arange(n) - np.repeat(last - per_row + 1, per_row)
    for _ in range(8):
        blank = np.flatnonzero(starts < ends)
        blank = blank[_SPACE[raw[starts[blank]]]]
        if not len(blank):
            break
        starts[blank] += 1
    else:  # long runs of white space
        solid = np.append(np.flatnonzero(~_SPACE[raw]), len(raw))
        starts = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    for _ in range(8):
        blank = np.flatnonzero(starts < ends)
        blank = blank[_SPACE[raw[ends[blank] - 1]]]
        if not len(blank):
            break
        ends[blank] -= 1
    else:
        solid = np.append(-1, np.flatnonzero(~_SPACE[raw]))
        ends = np.maximum(solid[np.searchsorted(solid, ends) - 1] + 1, starts)
    some = starts < ends
    return starts[some], ends[some], row[some], number[some].astype(np.int32)


#: Cells of the filters that are broadcast, a bit each: at least, for each id, and at most. The last bounds what is sent (8 MB).
FILTER_CELLS, FILTER_SPACE, MOST_FILTER_CELLS = 1 << 20, 8, 1 << 26


def cell_filter(ids: DataFrame, id_col: str) -> np.ndarray:
    """Which cells hold an id. There are at least FILTER_SPACE cells for each id up to MOST_FILTER_CELLS; a filter that is too full lets
    more pass, and joins do the rest."""
    size = int(min(MOST_FILTER_CELLS, max(FILTER_CELLS, 1 << (FILTER_SPACE * ids.count()).bit_length())))
    cells = ids.select(F.pmod(F.col(id_col), F.lit(size)).cast("int").alias("cell"))
    words = cells.select(F.expr("cell div 32").cast("int").alias("w"), F.expr("shiftleft(1L, cell % 32)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack_arrays(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32))], pa.binary())], names=["data"])

    bits = np.zeros(size // 32, np.uint32)
    for r in words.mapInArrow(pack, "data binary").collect():
        w, b = unpack_arrays([bytes(r["data"])], ["i4", "u4"])
        bits[w] = b
    return bits


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    cell = np.mod(ids.astype(np.int64), 32 * len(bits))
    return (bits[cell >> 5] >> (cell & 31).astype(np.uint32)) & np.uint32(1) > 0
