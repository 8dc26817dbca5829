"""Packing of token sequences by a linear grouping scheme: configurations of few sizes, actual documents, best fit."""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import bound_batches, materialize, release_memory

CAPACITY = 2048
SEPARATOR = 0
#: Lengths above this share of the capacity are grouped; the others fill the gaps.
LARGE = 2 / 5
#: Groups of equal cardinality.
GROUPS = 128
#: Pieces of one length are ranked in cells of about this many, at least MIN_CELLS.
CELL_ROWS = 100_000
MIN_CELLS = 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Runs of white space, or of anything else, that the faster library's pattern isn't given: it calls itself for each character.
BLANK_RUN, SOLID_RUN = 1 << 12, 1 << 16
_BLANK, _SOLID = re.compile(r"\s{%d}" % BLANK_RUN), re.compile(r"\S{%d}" % SOLID_RUN)


def has_long_run(text: str) -> bool:
    return len(text) >= BLANK_RUN and (_BLANK.search(text) is not None or len(text) >= SOLID_RUN and _SOLID.search(text) is not None)


def is_plain(spec: dict, special: list[str]) -> bool:
    """Whether a tokenizer is a byte-level BPE with the usual pattern, no normaliser, and ids in the order of its merges."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    usual = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE"
    if not usual or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    return ids == list(range(ids[0], ids[0] + len(ids))) and len(model["vocab"]) == 256 + len(ids) + sum(s in model["vocab"] for s in special)


@functools.cache
def encoder(path: str):
    """A function from a text to its ids as `tokenizers` gives them. Where the vocabulary file is a plain byte-level BPE, a faster library
    gives the same ids for most texts; one that holds a special token's string or a very long run goes to `tokenizers`."""
    import tiktoken
    from tokenizers import Tokenizer

    @functools.cache
    def own() -> Tokenizer:  # large, and rarely needed
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    if not is_plain(spec, special):
        return lambda text: own().encode(text, add_special_tokens=False).ids
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if has_long_run(text) or any(s in text for s in special):
            return own().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and a separator; a longer one is cut into
    pieces of the capacity of which the first may be shorter."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, cell in enumerate(batch.column(1)):
                ids = np.array([*encode(cell.as_py() or ""), SEPARATOR], "<u4")
                at, first = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    n = first if k == 0 else capacity
                    rows.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)
        release_memory()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- The plan, made of the counts of each length alone: its size doesn't depend on the number of documents ----


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """The fractional cutting-stock solution by column generation: patterns (how many of each size) with their number."""
    k = len(sizes)
    n = np.array(counts, float)
    patterns = [[0] * k for _ in range(k)]
    for i, s in enumerate(sizes):
        patterns[i][i] = capacity // s
    inverse = np.diag([1 / p[i] for i, p in enumerate(patterns)])
    x = inverse @ n
    s = np.array(sizes)
    for _ in range(20 * k):
        y = inverse.sum(0)
        # The best pattern at these prices: a knapsack, one more piece in each layer.
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(s.min())):
            more, pick = best.copy(), np.full(capacity + 1, -1)
            for g, size in enumerate(sizes):
                value = best[: capacity + 1 - size] + y[g]
                better = value > more[size:] + 1e-12
                more[size:][better] = value[better]
                pick[size:][better] = g
            best = more
            picks.append(pick)
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = [0] * k, capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                new[pick[c]] += 1
                c -= sizes[pick[c]]
        d = inverse @ np.array(new, float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * d
        x[out] = step
        inverse[out] /= d[out]
        for i in range(k):
            if i != out:
                inverse[i] -= d[i] * inverse[out]
        patterns[out] = new
    return [(tuple(p), float(v)) for p, v in zip(patterns, x) if v > 1e-9]


class Plan:
    """Runs (length, first rank, count, first sequence, offset): the piece of that length with that rank + i goes to
    that sequence + i, at that offset."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.used: dict[int, int] = {}  # pieces of each length placed so far
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap: first sequence and number of sequences
        self.gaps: list[int] = []

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, count, sequence, offset))
        self.used[length] = rank + count

    def leave(self, gap: int, sequence: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.open or not self.open[gap]:
                if gap not in self.open:
                    self.open[gap] = []
                bisect.insort(self.gaps, gap)
            self.open[gap].append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        """Each piece goes where it leaves least room; what is left open holds several sequences with one gap."""
        while count:
            i = bisect.bisect_left(self.gaps, length)
            if i == len(self.gaps):
                bins = -(-count // (self.capacity // length))
                self.leave(self.capacity, self.sequences, bins)
                self.sequences += bins
                continue
            gap = self.gaps[i]
            sequence, bins = self.open[gap].pop()
            if not self.open[gap]:
                del self.gaps[i]
            each = gap // length
            full = min(bins, count // each)
            if full == 0:
                each, full = count, 1
            for j in range(each):
                self.take(length, full, sequence, self.capacity - gap + j * length)
            count -= each * full
            self.leave(gap - each * length, sequence, full)
            self.leave(gap, sequence + full, bins - full)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> Plan:
    plan = Plan(capacity)
    if full := counts.get(capacity, 0):
        plan.take(capacity, full, 0, 0)
        plan.sequences = full
    big = [(n, counts[n]) for n in sorted(counts, reverse=True) if large * capacity < n < capacity]
    total = sum(c for _, c in big)
    if total:
        # Groups of equal cardinality, longest first; a group's lengths count as its longest.
        per = -(-total // groups)
        members: list[list[list[int]]] = [[]]
        room = per
        for n, c in big:
            while c:
                if not room:
                    members.append([])
                    room = per
                t = min(c, room)
                members[-1].append([n, t])
                c, room = c - t, room - t
        sizes, sums = [g[0][0] for g in members], [sum(t for _, t in g) for g in members]
        merged = sorted(set(sizes), reverse=True)
        at = {s: i for i, s in enumerate(merged)}
        pool: list[list[list[int]]] = [[] for _ in merged]
        number = [0] * len(merged)
        for s, g, n in zip(sizes, members, sums):
            pool[at[s]] += g
            number[at[s]] += n
        left = list(number)
        for pattern, value in sorted(configurations(merged, number, capacity), key=lambda p: -p[1]):
            bins = min([int(value + 1e-9), *(left[g] // k for g, k in enumerate(pattern) if k)])
            if bins <= 0:
                continue
            # Every slot takes that many actual pieces, in the order of their group; sequences with the same lengths stay together.
            slots = []
            for g, k in enumerate(pattern):
                for _ in range(k):
                    need, parts = bins, []
                    while need:
                        n, c = pool[g][0]
                        t = min(c, need)
                        parts.append((n, t))
                        need -= t
                        pool[g][0][1] -= t
                        if not pool[g][0][1]:
                            pool[g].pop(0)
                    slots.append(parts)
                left[g] -= k * bins
            cuts = sorted({0, bins, *(int(e) for parts in slots for e in np.cumsum([t for _, t in parts]))})
            for a, b in zip(cuts, cuts[1:]):
                offset = 0
                for parts in slots:
                    ends = np.cumsum([t for _, t in parts])
                    n = parts[int(np.searchsorted(ends, a, "right"))][0]
                    plan.take(n, b - a, plan.sequences + a, offset)
                    offset += n
                plan.leave(capacity - offset, plan.sequences + a, b - a)
            plan.sequences += bins
    for n in sorted((n for n in counts if n < capacity), reverse=True):
        plan.best_fit(n, counts[n] - plan.used.get(n, 0))
    return plan


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    The plan is made on the driver from the count of each length, at most `capacity` numbers; it has a number of runs
    that the capacity and the groups bound. Pieces find their run by their rank among those of their length, which is
    counted in cells of a hash, so that no task holds all pieces of one length.
    Edge cases: null and empty texts are one separator; rows that repeat are packed each; a null id stays null; a very long text is
    encoded whole and cut; pieces of one length are alike, so ties don't matter; other columns are ignored, whatever their names; an empty
    table gives an empty table. Reruns give the same packing."""
    spark = docs.sparkSession
    bound_batches(spark)
    table, _ = materialize(pieces(docs, path or tokenizer_path(), id_col, text_col, capacity), "packing-pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    plan = make_plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)
    cells = max(MIN_CELLS, sum(counts.values()) // CELL_ROWS)
    table = table.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = table.groupBy("length", "__cell").count().withColumn("__before", F.coalesce(before, F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "__cell").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = table.withColumn("__rank", rank).join(starts, ["length", "__cell"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__before")).alias("__rank"))
    schema = T.StructType([ranked.schema[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        runs = shared.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, ranks = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 48) + ranks, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(runs[at, 3] + ranks - runs[at, 1]), pa.array(runs[at, 4])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
