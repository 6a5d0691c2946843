"""Operators that return documents: columns with any name, repeated rows, missing ids, no rows."""

import pytest
from pyspark.sql import functions as F

from skuweave.llm import decontaminate, exact_dedup, line_dedup, mixing, ngram_join, toxicity

#: Names that the operators use inside, and some that they might.
NAMES = ["_key", "_dropped", "_left", "_text", "_sha", "_sha_kept", "_stay", "_toxic_evidence", "_mix_base",
         "_mix_source", "_mix_threshold", "_leak", "_of", "_rows", "key", "id", "line", "lid", "n", "h", "s",
         "component", "component_id", "set_id", "class", "size", "body", "ord", "first", "_KEY2"]
LONG = " ".join(f"w{i}" for i in range(60))


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("source"), F.lit("?"))).alias(n)
                              for n in NAMES])


def toxic_model(spark):
    docs = spark.createDataFrame([(i, f"idiot moron {i}" if i % 2 else f"good friend {i}")
                                  for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)],
                                   "doc_id long, quality int, toxic int")
    return toxicity.fit_toxicity(docs, labels)


def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30)))], "item_id long, text string")


OPERATORS = {
    "exact": lambda spark, docs: exact_dedup.drop_exact_duplicates(docs),
    "lines": lambda spark, docs: line_dedup.drop_duplicate_lines(docs),
    "ngrams": lambda spark, docs: ngram_join.drop_near_duplicates(docs),
    "toxic": lambda spark, docs: toxicity.drop_toxic(docs, toxic_model(spark)),
    "leaks": lambda spark, docs: decontaminate.drop_leaking(docs, benchmark(spark)),
    "mix": lambda spark, docs: mixing.mix(docs),
}
ROWS = [(1, LONG, "a"), (2, LONG + " more", "a"), (2, LONG + " more", "a"), (3, None, "b"), (4, "", None),
        (5, "some other text of a few words here", "b"), (None, "missing id of a text", "c"),
        (6, " ".join(f"b{i}" for i in range(30)), "c")]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_with_any_name(spark, name):
    docs = table(spark, ROWS)
    got = OPERATORS[name](spark, docs)
    assert got.columns[:len(docs.columns)] == docs.columns
    rows = got.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}-{r.source or '?'}" for n in NAMES)
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    want = OPERATORS[name](spark, plain).collect()
    assert sorted(map(str, want)) == sorted(str(r) for r in got.select(
        *[c for c in got.columns if c not in NAMES]).collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, table(spark, ROWS).limit(0)).collect() == []


def test_one_of_each_component_stays(spark):
    other = LONG.replace("w", "v")
    rows = [(1, LONG), (1, LONG), (2, LONG + " x"), (None, other), (None, other + " x"), (None, other),
            (7, "short text"), (7, "short text"), (8, None), (8, None), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.drop_near_duplicates(docs).collect()
    kept = sorted((r.doc_id or 0, (r.text or "")[:3]) for r in got)
    assert [k for k in kept if k[1] == "w0 "] == [(1, "w0 ")]
    assert [k for k in kept if k[1] == "v0 "] == [(0, "v0 ")]
    assert [k for k in kept if k[1] == "sho"] == [(7, "sho")]
    assert len([k for k in kept if k[0] in (8, 9)]) == 3  # nothing to compare: all stay
