"""Substring deduplication by prefix-partitioned suffix trees over words."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import PACKED, bound_batches, buffers, byte_values, chunks, mix, packed_batch, range_hashes, release_memory, spread_id, split_by, text_bytes, to_part, window_hashes, word_pieces, word_spans

WINDOW = 20
#: Words of an anchor: of the sequences of so many words in a suffix's first WINDOW words, the one with the smallest hash.
ANCHOR = 4
#: Cells in which anchors are counted, at least and at most; there are CELLS_A_GROUP times as many as groups.
CELLS = 1 << 12, 1 << 20
CELLS_A_GROUP = 16
#: Suffixes of a group: what a task builds a tree of at once.
GROUP_SUFFIXES = 1 << 19
#: Suffixes that a task gathers before it passes them on.
FLUSH = 1 << 19
#: Bytes of text that a task gathers before it passes them on.
FLUSH_TEXT = 32 << 20
#: Bytes of text of a bucket of documents, in which words are removed at once.
BUCKET_BYTES = 16 << 20
#: Words handled at once where bytes are gathered one by one.
SLICE = 1 << 16


def zstd() -> pa.Codec:
    return pa.Codec("zstd", 3)


@dataclass
class Suffixes:
    """Suffixes of at least `window` words over one run of bytes."""

    raw: np.ndarray
    starts: np.ndarray  # of each word, in raw
    ends: np.ndarray
    words: np.ndarray  # a hash of each word
    at: np.ndarray  # the word that each suffix starts with
    path: np.ndarray  # a hash of its first `window` words: unequal for unequal words in most cases, equal for equal ones in all
    doc: np.ndarray
    place: np.ndarray


def suffixes(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, places: np.ndarray | None, window: int):
    """The suffixes of rows, in pieces; places: of each row's first word."""
    for lo, part, off, before in word_pieces(raw, offsets, window - 1):
        starts, ends, first = word_spans(part, off)
        words = range_hashes(byte_values()[part], starts, ends, 0x5851F42D4C957F2D)
        path, row, place = window_hashes(words, first, window)
        if len(path):
            base = before if places is None else before + places[lo : lo + len(off) - 1][row]
            yield Suffixes(part, starts, ends, words, first[:-1][row] + place, path, ids[lo : lo + len(off) - 1][row], (place + base).astype(np.int32))


def concatenate(parts: list[Suffixes]) -> Suffixes:
    byte = np.cumsum([0] + [len(p.raw) for p in parts[:-1]])
    word = np.cumsum([0] + [len(p.words) for p in parts[:-1]])
    join = lambda name, base=None: np.concatenate([getattr(p, name) + b for p, b in zip(parts, base)] if base is not None else [getattr(p, name) for p in parts])
    return Suffixes(join("raw"), join("starts", byte), join("ends", byte), join("words"), join("at", word), join("path"), join("doc"), join("place"))


def name_words(s: Suffixes, which: np.ndarray) -> np.ndarray:
    """A number for each of these words: equal for equal words and for no others. Words of one hash are compared byte by byte."""
    _, model, name = np.unique(s.words[which], return_index=True, return_inverse=True)
    a, b, size = s.starts[which], s.starts[which][model][name], (s.ends - s.starts)[which]
    same = bool((size == size[model][name]).all())
    for lo in range(0, len(which) if same else 0, SLICE):
        n = size[lo : lo + SLICE]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (s.raw[np.repeat(a[lo : lo + SLICE], n) + step] != s.raw[np.repeat(b[lo : lo + SLICE], n) + step]).any():
            same = False
            break
    if same:
        return name
    data, names = s.raw.tobytes(), {}
    return np.array([names.setdefault(data[i:j], len(names)) for i, j in zip(a.tolist(), (a + size).tolist())], np.int64)


def nodes(s: Suffixes, some: np.ndarray, window: int) -> np.ndarray:
    """The tree's node at the window's depth above each of these suffixes: equal where the first `window` words are.

    Words are numbered; then prefixes of 2, 4, 8, ... words are numbered in turn as pairs of shorter ones, as when suffixes are
    sorted by prefix doubling; the window is two prefixes that overlap. Only words and numbers are compared, no hashes."""
    edge = np.bincount(s.at[some], minlength=len(s.words) + 1) - np.bincount(s.at[some] + window, minlength=len(s.words) + 1)
    needed = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    at = np.searchsorted(needed, s.at[some])
    rank, depth = name_words(s, needed), 1
    while 2 * depth <= window:
        rank = np.unique(rank[:-depth] * (rank.max() + 1) + rank[depth:], return_inverse=True)[1]
        depth *= 2
    return np.unique(rank[at] * (rank.max() + 1) + rank[at + window - depth], return_inverse=True)[1]


def leaves(s: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first leaf (smallest document, then place) of every node at the window's depth, and the later ones; a leaf at the very
    place of the first one (of a row that repeats) is neither. Both ascend.

    A suffix whose path no other has is a node of its own; of the others the subtree is built."""
    order = np.argsort(s.path)
    same = s.path[order[1:]] == s.path[order[:-1]]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    some = np.sort(order[shared])
    lead = np.ones(len(order), bool)
    if not len(some):
        return np.flatnonzero(lead), some
    node = nodes(s, some, window)
    rank = np.lexsort((s.place[some], s.doc[some], node))
    node, some = node[rank], some[rank]
    begins = np.concatenate([[True], node[1:] != node[:-1]])
    first = some[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    lead[some[~begins]] = False
    later = some[(s.doc[some] != s.doc[first]) | (s.place[some] != s.place[first])]
    return np.flatnonzero(lead), np.sort(later)


def anchors(s: Suffixes, window: int) -> np.ndarray:
    """A hash of each suffix's anchor. Neighbouring suffixes often share it, and equal windows always do."""
    size = min(ANCHOR, window)
    begin = np.arange(len(s.words) - size + 1)
    least, depth = range_hashes(s.words, begin, begin + size, 0x27BB2EE687B0B0FD), 1
    while 2 * depth <= window - size + 1:
        least = np.minimum(least[:-depth], least[depth:])
        depth *= 2
    return mix(np.minimum(least[s.at], least[s.at + window - size + 1 - depth]))


def squeeze(doc: np.ndarray, place: np.ndarray) -> bytes:
    """Documents and places in their order: runs of a document and steps, byte by byte, compressed."""
    begin = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(begin)
    step = np.diff(place, prepend=np.int32(0)).astype(np.int32)
    step[at] = place[at]
    ids = np.diff(doc[at], prepend=np.int64(0))
    counts = np.diff(np.append(at, len(doc))).astype(np.int32)
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in (ids, counts, step))
    return np.array([len(at), len(doc)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def expand(blob) -> tuple[np.ndarray, np.ndarray]:
    """What squeeze() was given."""
    m, n = np.frombuffer(blob, "<i8", 2).tolist()
    raw = np.frombuffer(pa.decompress(memoryview(blob)[16:], 12 * m + 4 * n, "zstd"), np.uint8)

    def column(at: int, size: int, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).reshape(-1).view(kind)

    ids, counts, step = column(0, m, "<i8"), column(8 * m, m, "<i4"), column(12 * m, n, "<i4")
    total = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(np.cumsum(ids), counts), (total - np.repeat(total[first] - step[first], counts)).astype(np.int32)


def unsqueeze(blobs) -> tuple[np.ndarray, np.ndarray]:
    parts = [expand(b) for b in blobs] or [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def pack_runs(doc: np.ndarray, place: np.ndarray, texts: list[bytes]) -> bytes:
    """Runs of words with the document and place of their first one."""
    head, lengths = squeeze(doc, place), np.array([len(t) for t in texts], "<i4")
    body = b"".join((lengths.tobytes(), *texts))
    return np.array([len(texts), len(head), len(body)], "<i8").tobytes() + head + zstd().compress(body, asbytes=True)


def unpack_runs(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, documents and places of what pack_runs was given."""
    n, head, size = np.frombuffer(blob, "<i8", 3).tolist()
    doc, place = expand(blob[24 : 24 + head])
    body = np.frombuffer(zstd().decompress(blob[24 + head :], size), np.uint8)
    return body[4 * n :], np.concatenate([[0], np.cumsum(body[: 4 * n].view("<i4"), dtype=np.int64)]), doc, place


def pack_texts(docs: DataFrame, bucket_at: int) -> DataFrame:
    """Rows of docs as (part, data): a task's rows of one bucket together, compressed, so that the shuffle moves less."""

    def run(batches):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            bucket = table.column(bucket_at).to_numpy()
            rows = []
            for part, at in split_by(bucket, np.arange(len(bucket))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=zstd())) as writer:
                    writer.write_table(table.take(pa.array(at)))
                rows.append((part, sink.getvalue().to_pybytes()))
            return packed_batch(rows)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_TEXT:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, PACKED)


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (doc % buckets).astype(np.int32)


def prime_at_least(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


def frequent_anchors(rows: DataFrame, cells: int, window: int) -> tuple[int, np.ndarray]:
    """How many suffixes there are, and the cells of anchors that are too frequent for one group."""

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            for s in suffixes(raw, offsets, np.zeros(batch.num_rows, np.int64), None, window):
                total += np.bincount(to_part(anchors(s, window), cells), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    by_cell = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = by_cell.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > GROUP_SUFFIXES // 2, F.struct("cell", "n"))).alias("cells")).first()
    total = found["n"] or 0
    return total, np.array(sorted(r["cell"] for r in found["cells"] if r["n"] > 4 * total / cells), np.int64)


def repeated_windows(docs: DataFrame, buckets: int, size: int, window: int = WINDOW) -> DataFrame:
    """Rows (part, data): for the documents of a bucket the places of windows whose words also start earlier.
    docs: id, text; size: bytes of text.

    1. Suffixes are dealt into groups that fit a task's memory, by a variable-length part of their first words: their anchor, or all
    `window` words where a count of anchors found it too frequent. Suffixes with equal windows meet, and neighbours mostly travel
    together, as one run of words, so a suffix costs about three words on its way and its group has what it needs to compare it.
    2. Suffixes that meet in the sending task already are compared there, and only the first of each node is sent: a passage that every
    document holds is sent once by a task. 3. A group builds its suffixes' tree: the nodes at the window's depth with several
    leaves are the repeats, and all leaves but the first are marked. Neighbouring marks make up a maximal repeat."""
    cells = min(CELLS[1], max(CELLS[0], power_of_two(CELLS_A_GROUP * size / 6 / GROUP_SUFFIXES)))
    total, frequent = frequent_anchors(docs, cells, window)
    often = np.zeros(cells, bool)
    often[frequent] = True
    groups = max(1, -(-2 * total // GROUP_SUFFIXES))
    marks_from = groups  # parts from here on are buckets of documents

    def marks(doc: np.ndarray, place: np.ndarray):
        for bucket, d, p in split_by(bucket_of(doc, buckets), doc, place):
            yield marks_from + bucket, squeeze(d, p)

    def send(batches):
        gathered, n = [], 0

        def flush():
            s = concatenate(gathered)
            lead, later = leaves(s, window)
            out = list(marks(s.doc[later], s.place[later]))
            key, at, doc, place = anchors(s, window)[lead], s.at[lead], s.doc[lead], s.place[lead]
            alone = often[to_part(key, cells)]
            key[alone] = mix(s.path[lead][alone])
            begins = np.ones(len(lead), bool)
            begins[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:]
            run = np.flatnonzero(begins)
            last = np.append(run[1:], len(lead)) - 1
            begin, end = s.starts[at[run]], s.ends[at[last] + window - 1]
            data = memoryview(s.raw.tobytes())
            for part, d, p, i, j in split_by(to_part(mix(key[run]), groups), doc[run], place[run], begin, end):
                out.append((part, pack_runs(d, p, [data[x:y] for x, y in zip(i.tolist(), j.tolist())])))
            for lo in range(0, len(out), 256):
                yield packed_batch(out[lo : lo + 256])

        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            for s in suffixes(raw, offsets, batch.column(0).to_numpy(), None, window):
                gathered.append(s)
                n += len(s.path)
                if n >= FLUSH:
                    yield from flush()
                    gathered, n = [], 0
        if n:
            yield from flush()
        release_memory()

    def tree(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part >= marks_from:
            return pa.table([pa.array([part - marks_from] * table.num_rows, pa.int32()), table["data"]], names=["part", "data"])
        s = concatenate([s for blob in table["data"] for s in suffixes(*unpack_runs(memoryview(blob.as_buffer())), window)])
        _, later = leaves(s, window)
        later = later[np.lexsort((s.place[later], s.doc[later]))]
        return pa.Table.from_batches([packed_batch([(b - marks_from, data) for b, data in marks(s.doc[later], s.place[later])])])

    return docs.mapInArrow(send, PACKED).groupBy("part").applyInArrow(tree, PACKED)


def cut(raw: np.ndarray, offsets: np.ndarray, covered: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, list[bytes], pa.Array]:
    """Words, removed words, what is kept, and the removed passages (first word, words) of each text; covered: for each the places of
    windows to remove."""
    starts, ends, first = word_spans(raw, offsets)
    cover = np.zeros(len(starts) + 1, np.int32)
    counts = np.diff(first)
    for i, places in enumerate(covered):
        places = places[places + window <= counts[i]]
        if len(places):
            np.add.at(cover, first[i] + places, 1)
            np.add.at(cover, first[i] + places + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    # Kept words one after the other, each with a space; a text's last space isn't part of it.
    kept_starts, size = starts[keep], (ends - starts)[keep] + 1
    padded, data = np.append(raw, np.uint8(0x20)), []
    for lo in range(0, len(size), SLICE):
        n = size[lo : lo + SLICE]
        stop = np.cumsum(n)
        out = padded[np.repeat(kept_starts[lo : lo + SLICE] - (stop - n), n) + np.arange(stop[-1])]
        out[stop - 1] = 0x20
        data.append(out.tobytes())
    data = b"".join(data)
    kept_before = np.concatenate([[0], np.cumsum(keep)])[first]
    edges = np.concatenate([[0], np.cumsum(size)])[kept_before]
    kept = [data[lo : max(lo, hi - 1)] for lo, hi in zip(edges, edges[1:])]
    gone = np.zeros(len(keep) + 1, bool)
    gone[:-1] = ~keep
    begins = gone[:-1].copy()
    begins[1:] &= keep[:-1]
    begins[first[:-1][first[:-1] < len(keep)]] = gone[first[:-1][first[:-1] < len(keep)]]
    begin = np.flatnonzero(begins)
    limit = np.minimum(np.append(begin[1:], len(keep)), first[np.searchsorted(first, begin, "right")] if len(begin) else begin)
    removed = np.concatenate([[0], np.cumsum(gone[:-1])])
    passages = pa.StructArray.from_arrays([pa.array(begin - first[np.searchsorted(first, begin, "right") - 1], pa.int64()), pa.array(removed[limit] - removed[begin], pa.int64())], names=["start", "length"])
    return counts, counts - np.diff(kept_before), kept, pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, first), pa.int32()), passages)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, repeats of every row: its words without those covered by a window of `window`
    consecutive words that also starts earlier (in a document with a smaller id, or earlier in the same one). repeats lists the maximal
    passages that were removed, by first word and length.

    Words decide, never hashes: a hash that two suffixes share only lets them be compared. Texts are shuffled once, to meet the marks
    of their bucket of documents.
    Edge cases: a null text has no words. Null ids sort last, in the order of a hash of their text; null ids of one text count as one
    document, and so do rows that repeat an id: a window at the same place of the same id isn't earlier than itself, and a place marked
    in one of these rows is marked in all. A very long text is handled in pieces that overlap. An empty table gives an empty table.
    Other columns are ignored, whatever their names."""
    bound_batches(docs.sparkSession)
    size = text_bytes(docs, text_col)
    buckets = prime_at_least(max(2, size // BUCKET_BYTES))
    key = spread_id(id_col, text_col)
    found = repeated_windows(docs.select(key.alias("key"), F.col(text_col).alias("text")), buckets, size, window)
    left = pack_texts(docs.select(F.pmod(key, F.lit(buckets)).cast("int").alias("part"), key.alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), 0)
    passage = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", passage)])

    def apply(texts: pa.Table, marked: pa.Table) -> pa.Table:
        doc, place = unsqueeze(b.as_buffer() for b in marked["data"])
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        tables = []
        for batch in (b for data in texts["data"] for b in pa.ipc.open_stream(data.as_buffer())):
            ids = batch.column("key").to_numpy()
            offsets, raw = buffers(batch.column("text"))
            for lo, hi in chunks(offsets):
                mine = ids[lo:hi]
                a, b = np.searchsorted(doc, mine, "left"), np.searchsorted(doc, mine, "right")
                n, removed, kept, repeats = cut(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], [place[x:y] for x, y in zip(a, b)], window)
                tables.append(pa.table([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), repeats], names=schema.names))
        return pa.concat_tables(tables) if tables else empty_table(schema)

    return left.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(apply, schema)


def empty_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(list_slice(w, k + 1, k + 20), ' ') AS words FROM d, unnest(range(0, len(w) - 19)) t(k)),
later AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, k) > 1),
cover AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM later),
word AS (SELECT doc_id, i, w[i + 1] AS x FROM d, unnest(range(0, len(w))) t(i)),
kept AS (SELECT doc_id, count(c.i) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE c.i IS NULL) AS kept FROM word LEFT JOIN cover c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
