"""Every operator and every pipeline stage on the rows that real tables hold: nulls in any column, null ids, empty and very long texts, ties,
repeated rows, no rows, and further columns with the names that operators use themselves."""

import collections

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from graphspark.llm import ann, exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, substring_dedup, toxicity, warc

CLASH = ("weight", "root", "id", "key", "size", "taken", "kept", "part", "h", "cell", "line", "count", "lang_score", "n_lines", "class_id", "__text", "row", "copy", "members", "digest")
LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000)) + "\n" + "x" * 700_000 + "\n" + " " * 10_000
TEXTS = [None, "", " \n ", "12 34", "a short english text about the house and the water", LONG, LONG, "same words here again and again to make it a few words longer than twenty words are so that it counts as one window", None]


def table(spark, clash=True):
    """Rows (id, text) with each text twice over ids that repeat, tie and are null."""
    rows = []
    for k, t in enumerate(TEXTS):
        rows += [(k, t, "en" if k % 2 else None, None if k % 3 else "s", 1), (None if k % 2 else k, t, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(f"v-{c}") for c in CLASH}) if clash else df


OPERATORS = {
    "op1": lambda spark, d: exact_dedup.exact_dedup(d),
    "op2": lambda spark, d: toxicity.score(d, toxicity.learn(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))),
    "op3": lambda spark, d: language_id.identify(d, language_id.learn(d)),
    "op4": lambda spark, d: substring_dedup.remove_repeats(d),
    "op5": lambda spark, d: jaccard_join.similarity_classes(d),
    "op7": lambda spark, d: packing.pack(d).where("piece = 0"),
    "op8": lambda spark, d: mixing.mix(d),
    "op10": lambda spark, d: line_dedup.dedup_lines(d),
}
KEEPS_COLUMNS = {"op1": ("kept",), "op2": (), "op3": ("lang_score",), "op5": ("class_id",), "op8": ("size", "taken"), "op10": ("n_lines",)}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    docs = table(spark)
    found = OPERATORS[name](spark, docs).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    if name in KEEPS_COLUMNS:
        for c in set(CLASH) - set(KEEPS_COLUMNS[name]):
            assert all(r[c] == f"v-{c}" for r in found), c
    by_text = collections.defaultdict(set)
    if name in ("op1", "op3", "op2"):
        texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").where("doc_id is not null").collect()}
        column = {"op1": "group_size", "op2": "toxicity", "op3": "lang_pred"}[name]
        for r in found:
            if r["doc_id"] is not None:
                by_text[texts[r["doc_id"]] or ""].add(r[column])
        assert all(len(v) == 1 for v in by_text.values())
    empty = OPERATORS[name](spark, docs.where("false"))
    assert empty.count() == 0 and empty.columns == list(found[0].asDict())


def test_results_of_long_and_repeated_rows(spark):
    docs = table(spark, clash=False)
    cut = {(r["doc_id"], r["n_words"]): r for r in OPERATORS["op4"](spark, docs).collect()}
    long = len(LONG.split())
    assert cut[5, long]["n_removed"] == 0 and cut[6, long]["kept_text"] == "" and cut[6, long]["repeats"][0]["length"] == long
    joined = {(r["doc_id"], r["n_copies"], r["class_id"], r["n_links"]) for r in OPERATORS["op5"](spark, docs.where("doc_id in (5, 6)")).collect()}
    assert joined == {(5, 3, 5, 2), (6, 3, 5, 2)}
    lines = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in OPERATORS["op10"](spark, docs.where("doc_id in (5, 6)")).collect()}
    assert lines == {5: (2, 0), 6: (2, 2)}


def test_very_long_lines_and_texts_in_pieces(spark):
    """Near copies of a text, and of a single line, that are far longer than what is handled at once."""
    words = " ".join(f"w{i * 7919 % 10007}" for i in range(80_000))
    other = words.replace("w55 ", "v55 ")
    docs = spark.createDataFrame([(1, words), (2, other), (3, "short one")], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similarity_classes(docs).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}
    assert {(r["doc_id"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()} == {(1, 0), (2, 1), (3, 0)}


def test_warc(spark, tmp_path):
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (None, None, None), (None, None, "y" * 3_000_000), (2, "v", "x" * 200), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first_id", "nth", "n", "payload", "dealt", "size")})
    for name, part in (("some", pages), ("none", pages.where("false"))):
        warc.write_warc(part, str(tmp_path / name))
        found = warc.resolve(warc.assemble(warc.read_warc(spark, str(tmp_path / name)))).collect()
        assert collections.Counter(r["page"] for r in found) == (collections.Counter({"1": 2, None: 2, "2": 1, "3": 1}) if name == "some" else {})


def test_ann(spark):
    vectors = spark.createDataFrame([(100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0])], "vec_id long, embedding array<double>")
    found = ann.search(vectors.withColumns({c: F.lit(1) for c in ("part", "block", "blocks", "deal", "score", "rank", "query_id")})).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(100, 1, 1, 0.0)]
    assert ann.search(vectors.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages(spark, name):
    stage = dict(P.STAGES)[name]
    docs = table(spark)
    found = stage(spark, docs, "")
    assert stage(spark, docs.where("false"), "").count() == 0
    if name == "packing":
        assert found.where("piece = 0").count() == docs.count()
        return
    assert found.columns == docs.columns
    rows = found.collect()
    assert all(r[c] == f"v-{c}" for r in rows for c in CLASH)
    texts = collections.Counter(r["text"] for r in rows)
    if name == "language_id":
        assert not set(texts) & {None, "", " \n ", "12 34"} and texts[TEXTS[4]] == 2 and all(r["lang"] == "en" for r in rows)
    if name == "line_dedup":
        assert texts[None] == 4 and texts[TEXTS[4]] >= 1 and len(rows) < docs.count()
    if name == "jaccard_join":
        assert texts[None] == 4 and texts[LONG] == 1 and texts[TEXTS[7]] == 1
    if name == "mixing":
        assert texts[""] == 2 and all(n <= 6 for n in texts.values())
