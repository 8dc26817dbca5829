"""Language identification by prediction by partial matching (PPM) with frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import CHUNK_BYTES, bound_batches, buffers, chunks, held_out, new_name, release_memory

#: Documents learned from per language, the longest that is learned from, and the bytes of text per language (as expected of a
#: sample at a fixed rate). The only sample that is drawn.
TRAIN_DOCS = 300
TRAIN_DOC_BYTES = 1 << 16
TRAIN_BYTES = 2 << 20
#: Longest context in bytes.
ORDER = 3
#: Size of the table of code lengths; it bounds how many contexts the trees keep, the most frequent first.
TABLE_BYTES = 16 << 20
#: Contexts that are kept in any case: with very many languages the table grows with their number instead.
MIN_CONTEXTS = 2048
#: Bytes of evidence that a score counts at most, so that it doesn't saturate on long texts.
SCORE_BYTES = 50


#: Texts of fewer bytes are too short to be held against the rate of the texts learned from.
RATE_BYTES = 100


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # symbol of each byte; bytes never seen share the last one
    context: np.ndarray  # row of the longest known context of three symbols
    bits: np.ndarray  # (contexts * symbols, languages) code lengths
    worst_rate: float = 8.0  # most bits a byte that a text learned from takes under the language that fits it best


def fit(texts: list[bytes], labels: list[str], table_bytes: int = TABLE_BYTES, min_contexts: int = MIN_CONTEXTS) -> Model:
    """One context tree per language over a shared set of contexts. The probability of a symbol follows PPM's method C
    with exclusion: in a context seen n times before q different symbols, a seen one has count / (n + q), the others
    share the escape q / (n + q) as the next shorter context has it, without the seen ones. Statistics are frozen, so
    each context is a table row and a text's code length is a sum.

    Counts are kept sparse, one language and order after the other: the driver needs some 30 bytes for a byte of one language's
    texts, and the table."""
    languages = sorted(set(labels))
    seen = np.zeros(256, bool)
    for text in texts:
        seen[np.frombuffer(text, np.uint8)] = True
    seen[0x20] = True
    a = int(seen.sum()) + 1
    symbol = np.full(256, a - 1, np.uint8)
    symbol[seen] = np.arange(a - 1)
    rooms = max(min_contexts, table_bytes // (4 * a * max(1, len(languages))))
    pad = b" " * ORDER

    def counts_of(language: str, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of that order with the symbol that follows, as one number, and how often each comes."""
        s = symbol[np.frombuffer(b"".join(pad + t for t, k in zip(texts, labels) if k == language), np.uint8)]
        lengths = np.array([len(t) for t, k in zip(texts, labels) if k == language])
        code = np.zeros(len(s) - ORDER, np.int64)
        for j in range(ORDER - order, ORDER + 1):
            code *= a
            code += s[j : len(s) - ORDER + j]
        begin = np.cumsum(lengths + ORDER) - lengths - ORDER
        real = np.ones(len(code), bool)
        for j in range(ORDER):  # what would predict the spaces before the next text
            real[begin[1:] - ORDER + j] = False
        code = code[real]
        code.sort()
        return np.unique(code, return_counts=True)

    sparse = [[counts_of(k, order) for k in languages] for order in range(ORDER + 1)]
    found = []
    for order in range(1, ORDER + 1):
        of = np.concatenate([c // a for c, _ in sparse[order]] or [np.zeros(0, np.int64)])
        context, at = np.unique(of, return_inverse=True)
        found.append((context, np.bincount(at, np.concatenate([n for _, n in sparse[order]] or [np.zeros(0)]), len(context))))
    every = np.sort(np.concatenate([n for _, n in found]))[::-1]
    least = every[rooms - 1] + 1 if len(every) > rooms - 1 else 1
    kept = [np.zeros(1, np.int64)] + [context[n >= max(least, 2)] for context, n in found]
    del found, every
    base = np.full(a, 1 / 256)
    base[-1] = (257 - a) / 256
    table = np.empty((sum(map(len, kept)), len(languages), a), np.float32)
    start, lookup = 0, np.zeros(1, np.int32)
    for order, mine in enumerate(kept):
        longer = np.tile(lookup, a) if order else lookup  # the oldest symbol is the most significant one
        parents = longer[mine]
        longer[mine] = start + np.arange(len(mine), dtype=np.int32)
        for lo in range(0, len(mine), 1024):
            hi = min(lo + 1024, len(mine))
            counts = np.zeros((hi - lo, len(languages), a))
            for li, (code, n) in enumerate(sparse[order]):
                i, j = np.searchsorted(code, (mine[lo] * a, (mine[hi - 1] + 1) * a))
                row = np.searchsorted(mine[lo:hi], code[i:j] // a)
                here = mine[lo:hi][row] == code[i:j] // a
                counts[row[here], li, (code[i:j] % a)[here]] = n[i:j][here]
            low = np.broadcast_to(base, counts.shape) if order == 0 else table[parents[lo:hi]]
            n, had = counts.sum(2, keepdims=True), counts > 0
            q = had.sum(2, keepdims=True)
            rest = np.maximum(1 - (low * had).sum(2, keepdims=True), 1e-9)
            table[start + lo : start + hi] = np.where(n == 0, low, np.where(had, counts / np.maximum(n + q, 1), q / np.maximum(n + q, 1) * low / rest))
        lookup, start = longer, start + len(mine)
        sparse[order] = []
    bits = np.ascontiguousarray(table.transpose(0, 2, 1))
    del table
    np.log2(bits, out=bits)
    np.negative(bits, out=bits)
    bits[:, -1] += np.float32(np.log2(257 - a))
    model = Model(languages, symbol, lookup, bits.reshape(len(bits) * a, len(languages)))
    rates = [rate(model, t).min() for t in texts if len(t) >= RATE_BYTES]
    model.worst_rate = float(max(rates, default=8.0))
    return model


def rate(model: Model, text: bytes) -> np.ndarray:
    """Bits a byte of one text under each language."""
    return code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] / max(1, len(text))


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Bits of each text under each language. A longer text is handled in pieces of limit bytes, with the context carried over."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    a = len(model.bits) // (int(model.context.max()) + 1)
    space = int(model.symbol[0x20])

    def costs(s: np.ndarray, begin: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """Code lengths of symbols; texts begin at these places, the first one with the symbols carried before it."""
        context = np.zeros(len(s), np.int32)
        for back in range(ORDER, 0, -1):
            past = np.concatenate([carried[ORDER - back :], s[:-back]])[: len(s)].astype(np.int32)
            for j in range(back):
                at = begin + j
                past[at[at < len(s)]] = space  # for a shorter text this touches the next one's start, which has spaces before it too
            context = context * a + past
        return model.bits[model.context[context].astype(np.int64) * a + s]

    blank = np.full(ORDER, space, np.uint8)
    for lo, hi in chunks(offsets, limit):
        if hi - lo == 1:
            carried = blank
            for at in range(int(offsets[lo]), int(offsets[hi]), limit):
                s = model.symbol[raw[at : min(at + limit, int(offsets[hi]))]]
                out[lo] += costs(s, np.zeros(0, np.int64), carried).sum(0, dtype=np.float64)
                carried = np.concatenate([carried, s])[-ORDER:]
            continue
        off, s = offsets[lo : hi + 1] - offsets[lo], model.symbol[raw[offsets[lo] : offsets[hi]]]
        if not len(s):
            continue
        begin = off[:-1][np.diff(off) > 0]
        out[lo:hi][np.diff(off) > 0] = np.add.reduceat(costs(s, begin, blank), begin, axis=0, dtype=np.float64)
    return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.zeros(len(offsets) - 1, bool)
    some = np.diff(offsets) > 0
    if some.any():
        found[some] = np.logical_or.reduceat(_ASCII_LETTER[raw], offsets[:-1][some])
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language (und: null, or no letter), score, and bits a byte of each text."""
    offsets, raw = buffers(column)
    if not model.languages:
        return ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column))
    bits, n = code_lengths(model, raw, offsets), np.diff(offsets)
    rates = bits / np.maximum(n, 1)[:, None]
    gap = (rates - rates.min(1, keepdims=True)) * np.minimum(n, SCORE_BYTES)[:, None]
    weight = np.exp2(-gap)
    known, best = has_letter(column, raw, offsets), rates.argmin(1)
    names = [model.languages[b] if k else "und" for b, k in zip(best, known)]
    return names, np.where(known, weight.max(1) / weight.sum(1), 0.0), rates.min(1)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from about train_docs documents of each language, chosen by a hash of the id among those not held out.

    The sample is bounded (train_docs documents of up to TRAIN_DOC_BYTES, about TRAIN_BYTES of text per language) and is fitted on the
    driver; the counts that set the rate cover all documents that may be learned from. Without any the model has no language."""
    length = F.octet_length(text_col)
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).where((length > 0) & (length <= TRAIN_DOC_BYTES))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(length.cast("long")).alias("size")).collect()
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    if not counts:
        return fit([], [])
    rates = F.coalesce(*[F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, train_docs / r["n"], TRAIN_BYTES / r["size"]))) for r in counts], F.lit(0.0))
    sample = rows.where(u < rates).select(F.encode(text_col, "utf-8"), lang_col).collect()
    texts, labels = [bytes(r[0]) for r in sample], [r[1] for r in sample]
    del sample
    model = fit(texts, labels)
    del texts
    release_memory()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1) and bits_per_byte to the columns in keep (default: all).

    Reads whole texts, long ones in pieces; a row's result depends on its text alone, so rows that repeat have the same one. The model is a
    table of a fixed size that is broadcast once. Null texts and texts without a letter are und with score 0; an empty table gives an
    empty table; columns named like the results are replaced, others are kept; ties go to the language that sorts first."""
    spark = docs.sparkSession
    bound_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score", "bits_per_byte")]
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches):
        for batch in batches:
            names, score, bits = predict(shared.value, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(names, pa.string()), pa.array(score), pa.array(bits)], names=[f.name for f in schema])

    return docs.select(*keep, F.col(text_col).alias(new_name(keep))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
