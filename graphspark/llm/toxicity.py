"""Toxicity by a weighted lexicon that is matched by an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import bound_batches, held_out, materialize, new_name

#: Labelled documents learned from, per class, and the longest that is learned from. The only sample that is drawn.
TRAIN_DOCS = 4000
TRAIN_DOC_BYTES = 1 << 15
#: Entries of the lexicon and of the exceptions at most, by weight.
MAX_ENTRIES = 4000
#: Stems have this many characters.
STEM = (4, 8)
THRESHOLD = 0.3

# Letters of other scripts, digits and signs that stand for Latin letters. i, l and 1 fold to one letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "l", "ј": "j", "ѕ": "s", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "l", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "l", "ɑ": "a", "ɡ": "g", "ɩ": "l",
}
SUBSTITUTIONS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "l", "|": "l", "i": "l", "€": "e", "£": "l"}
# Not letters: removed, as they are put between letters without being seen.
INVISIBLE = "­​‌‍⁠﻿"

_WIDE = {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}
_TABLE = {**_WIDE, **{ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTIONS).items()}, **{ord(c): None for c in INVISIBLE}}
for _wide, _plain in _WIDE.items():
    _TABLE[_wide] = SUBSTITUTIONS.get(_plain, _plain)
_ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "€£" + INVISIBLE + "！-～]")
_PLAIN = str.maketrans({k: v for k, v in SUBSTITUTIONS.items() if ord(k) < 128})
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, with homoglyphs, digits and signs as the letters that they stand for."""
    text = text.lower()
    return text.translate(_TABLE if _ODD.search(text) else _PLAIN)


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)  # folded start of a word: weight
    exceptions: list[str] = field(default_factory=list)  # folded phrases in which no entry counts
    coefficients: tuple[float, float, float] = (-2.0, 1.0, 0.0)  # of 1, log of the weight, log of the weight by length


def automaton(model: Model):
    auto = ahocorasick.Automaton()
    for k, w in model.stems.items():
        auto.add_word(k, (len(k), w))
    for k in model.exceptions:
        if k not in model.stems:
            auto.add_word(k, (len(k), None))
    if len(auto):
        auto.make_automaton()
    return auto


def matches(auto, text: str) -> list[tuple[int, int, float]]:
    """Start, end and weight of the lexicon's entries in a folded text: at a word's start, the longest at each place,
    outside of exception phrases."""
    if not len(auto):
        return []
    best: dict[int, tuple[int, float]] = {}
    free = []
    for end, (n, weight) in auto.iter(text):
        start = end + 1 - n
        if start and text[start - 1].isalnum():
            continue
        if weight is None:
            if end + 1 == len(text) or not text[end + 1].isalnum():
                free.append((start, end + 1))
        elif n > best.get(start, (0, 0.0))[0]:
            best[start] = n, weight
    if not free:
        return [(s, s + n, w) for s, (n, w) in best.items()]
    free.sort()
    begins, reach = [a for a, _ in free], list(itertools.accumulate((b for _, b in free), max))
    return [(s, s + n, w) for s, (n, w) in best.items() if not ((i := bisect.bisect_right(begins, s)) and reach[i - 1] > s)]


def features(found: list, text: str) -> tuple[float, float]:
    total = sum(w for _, _, w in found)
    words = text.count(" ") + text.count("\n") + 1
    return math.log1p(total), math.log1p(100 * total / words)


def probability(model: Model, auto, text: str | None) -> float:
    folded = fold(text or "")
    x, y = features(matches(auto, folded), folded)
    a, b, c = model.coefficients
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def fit(texts: list[str], toxic: list[int], max_entries: int = MAX_ENTRIES) -> Model:
    """Half of the documents give the entries, and the phrases in which these are harmless; the other half gives the
    coefficients, so that entries found by chance don't seem certain."""
    half = [(fold(t), y) for t, y in zip(texts[::2], toxic[::2])]
    n1, n0 = sum(y for _, y in half), sum(1 - y for _, y in half)
    if not n1 or not n0:
        return Model()
    count = Counter(), Counter()
    for text, y in half:
        words = {m[0] for m in _WORD.finditer(text)}
        count[y].update({w[:n] for w in words for n in range(STEM[0], STEM[1] + 1) if len(w) >= n} | {w for w in words if len(w) < STEM[0]})

    def weight(k: str) -> float:
        return math.log((count[1][k] + 0.5) / (n1 + 1)) - math.log((count[0][k] + 0.5) / (n0 + 1))

    least = max(4, n1 // 250)
    good = {k: weight(k) for k, c in count[1].items() if c >= least and weight(k) > 2.0}
    # A longer stem only stays if its shorter ones don't say as much.
    stems = {k: w for k, w in good.items() if not any(good.get(k[:n], 0) >= w - 1.0 for n in range(1, len(k)))}
    model = Model(dict(sorted(stems.items(), key=lambda x: (-x[1], x[0]))[:max_entries]))
    auto = automaton(model)
    phrase = Counter(), Counter()
    for text, y in half:
        spans = [m.span() for m in _WORD.finditer(text)]
        at = {s: i for i, (s, _) in enumerate(spans)}
        for s, _, _ in matches(auto, text):
            if (i := at.get(s)) is not None:
                phrase[y].update({text[spans[j][0] : spans[j + 1][1]] for j in (i - 1, i) if 0 <= j and j + 1 < len(spans)})
    model.exceptions = [k for k, c in phrase[0].most_common(max_entries) if c >= 3 and not phrase[1][k]]
    auto = automaton(model)
    rest = [(fold(t), y) for t, y in zip(texts[1::2], toxic[1::2])]
    x = np.array([(1.0, *features(matches(auto, t), t)) for t, _ in rest]).reshape(-1, 3)
    y = np.array([y for _, y in rest], float)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    model.coefficients = tuple(map(float, beta))
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from about train_docs labelled documents of each class, chosen by a hash of the id among those not held out.

    The sample is about 2 * train_docs texts of TRAIN_DOC_BYTES at most, fitted on the driver; what is broadcast are their ids and labels.
    The counts that set the rates cover all documents that may be learned from. Ids that repeat are learned from once."""
    rows = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null").dropDuplicates(["__id"])
    short = docs.where(F.octet_length(text_col) <= TRAIN_DOC_BYTES).select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    rows = rows.join(short, "__id")
    counts = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
    u = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("__y") == 1, F.lit(min(1.0, train_docs / counts.get(1, 1)))).otherwise(F.lit(min(1.0, train_docs / counts.get(0, 1))))
    chosen, _ = materialize(rows.where(u < rate), "toxicity-labels")
    sample = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("__text")).where(F.octet_length("__text") <= TRAIN_DOC_BYTES).join(F.broadcast(chosen), F.col("__of") == F.col("__id")).select("__id", "__text", "__y").collect()
    first = {r[0]: r for r in sorted(sample, key=lambda r: (r[0], r[1]))[::-1]}
    sample = [first[k] for k in sorted(first)]
    return fit([r[1] for r in sample], [r[2] for r in sample])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds toxicity (0 to 1) and n_matches to the columns in keep (default: all).

    The score depends on the whole text alone, so rows that repeat have the same one, and takes time in proportion to its length. The
    model is at most 2 * MAX_ENTRIES short strings. A null text counts as empty, which has the score of a text without matches; of entries
    that start at one place the longest counts; an empty table gives an empty table; columns named like the results are replaced, others
    are kept."""
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("toxicity", "n_matches")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("toxicity", T.DoubleType()), T.StructField("n_matches", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        auto = automaton(model)
        a, b, c = model.coefficients
        for batch in batches:
            values, hits = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i, cell in enumerate(batch.column(batch.num_columns - 1)):
                text = fold(cell.as_py() or "")
                found = matches(auto, text)
                x, y = features(found, text)
                values[i], hits[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))), len(found)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(values), pa.array(hits)], names=[f.name for f in schema])

    return docs.select(*keep, F.col(text_col).alias(new_name(keep))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = score(docs, learn(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
