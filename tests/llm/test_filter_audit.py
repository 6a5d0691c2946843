import itertools
import random

import pytest
from pyspark.sql import functions as F

from skuweave.llm import filter_audit as fa


def brute(docs, labels, letters, fails):
    """Every order, document by document."""
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(i, fails(i, t)) for i, t, p in docs if (p or "") == part]
        totals = dict.fromkeys(letters, 0)
        for order in itertools.permutations(letters):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                totals[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in rows) - len(gone),
                    sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone),
                    sum(r[0] in toxic for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return out


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in (*fa.STEP_COUNTS, "shapley")]
            for r in df.collect()}


def test_against_every_order(spark):
    rng = random.Random(5)
    texts = ["", "a b c", "Aa BB c", "x # y", "a b a b " * 30, "w%d " * 3, "same", "SAME |"]
    texts += [" ".join(f"{rng.choice('abcdef')}{rng.randrange(n)}" for _ in range(120))
              for n in (2, 30, 900)]
    docs = [(i, rng.choice([*texts, None]), rng.choice(["en", "de", "", None])) for i in range(80)]
    docs += [(5, docs[5][1], docs[5][2])] * 2 + [(None, "same", "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [
        (3, 1, 1), (3, 0, 0), (None, 1, 1)]

    def fails(i, text):
        text = text or ""
        words = text.split(" ")
        words = [w for w in words if w]
        out = {"A"} if len(words) < 100 else set()
        out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        out |= {"D"} if set(text) & set("#$%&*|") else set()
        return out | ({"E"} if i is not None and any(
            j is not None and j < i and (t or "") == text for j, t, _ in docs) else set())

    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS mask", "2 AS digest", "3 AS first", "4 AS id", "'x' AS part").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, [r for r in labels if r[0] is not None], "ABCDE", fails)
    got = rows_of(fa.filter_audit(df, marks))
    assert got == want and len(got) == 3 * 600


def test_own_filters_and_many_parts(spark):
    docs = [(i, "x" * (i % 7), f"p{i % 40}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = {"s": F.length("text") < 3, "t": F.col("doc_id") > 100,
               "n": F.lit(None).cast("boolean")}

    def fails(i, text):
        return ({"s"} if len(text) < 3 else set()) | ({"t"} if i > 100 else set())

    want = brute(docs, [], "stn", fails)
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "300")  # several recursions
    try:
        assert rows_of(fa.filter_audit(df, labels, filters)) == want
    finally:
        spark.conf.unset(limit)


def test_empty_table_and_wrong_letters(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(df, labels).collect() == []
    with pytest.raises(ValueError):
        fa.filter_audit(df, labels, {"ab": F.lit(True)})
