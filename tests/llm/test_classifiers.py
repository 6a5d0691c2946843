"""Toxicity and quality: held-out accuracy, restoring, defined cases; the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skuweave.llm import quality, toxicity
from skuweave.llm.queries import QUERIES

MIDDLE, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = QUERIES[name](spark, MIDDLE)
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or score is null").count() == 0
    rows = got.where("held_out").join(labels, "doc_id")
    assert rows.where(F.col("predicted") == F.col(label)).count() >= least * rows.count()


def words(rng, kind):
    return ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(30)] + kind


def labelled(spark, count=300):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(count):
        toxic = i % 3 == 0
        body = words(rng, ["idiot", "moron"] if toxic else ["friend"])
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        labels.append((i, 0 if toxic else 1, int(toxic)))
    return (spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, evidence double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_disguises_are_undone(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    restore = toxicity.Restorer(toxicity.LetterModel(model.letters))
    for disguise in ("1d10t", "IDI0T!", "iiidiot", "i.d.i.o.t", "m0r0n,", "m-o-r-o-n"):
        assert {"idiot", "moron"} & set(restore.text(disguise).split()), disguise
    assert "idiot" in restore.text("you i d i o t there").split()
    assert restore.text("friend 555-3752 an%%%") == "friend 555-3752 an"
    rows = [(1, "friend friend"), (2, "what an 1d10t you are"), (3, None), (4, ""), (None, "m o r o n"),
            (5, "friend " * 20_000), (2, "what an 1d10t you are")]
    new = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, evidence double")
    got = [(r.doc_id, r.predicted) for r in toxicity.toxicity_scores(new, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 1), (3, 0), (4, 0), (None, 1), (5, 0), (2, 1)], key=str)
    kept = toxicity.drop_toxic(new, model)
    assert kept.columns == new.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert toxicity.restored_texts(new, model).count() == 7


@pytest.fixture(scope="module")
def restore():
    counts = toxicity.grams({w: 50 for w in "idiot better letter chapter you friend moron".split()})
    return toxicity.Restorer(toxicity.LetterModel(counts))


@pytest.mark.parametrize("token", ["Chapter" + "." * 100_000 + "5", "!" * 100_000 + "x", "." * 100_000,
                                   "a!" * 50_000, "$" * 100_000, "1a" * 50_000, "(" * 50_000 + "a" * 50_000])
def test_one_very_long_token(restore, token):
    import time
    began = time.time()
    restore.token(token)
    assert time.time() - began < 15


@pytest.mark.parametrize("token, want", [
    ("idi" + "o" * 60 + "t", "idiot"), ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("[better]", "better"),
    ("...friend!!!", "friend"), ("you!", "you"), ("$$moron", "moron"), ("letter", "letter"),
    ("1234567", "1234567"), ("", "")])
def test_tokens(restore, token, want):
    assert restore.token(token) == want


def test_viterbi_against_all_paths(restore):
    """The best of all ways to read a short token, tried one by one."""
    import itertools
    model = restore.model
    for word in ("1d10t", "m0r0n", "y0u", "b3tt3r", "id!ot", "fr13nd"):
        options = []
        for char, run in ((c, len(list(g))) for c, g in itertools.groupby(word)):
            if char.isalpha():
                options.append([(char * run, toxicity.KEEP), *([(char, toxicity.HALVE)] * (run == 2))])
            else:
                read = [(x * k, toxicity.SWAP) for x in toxicity.LEET.get(char, "")
                        for k in sorted({1, min(run, 2)})]
                drop = toxicity.DROP_UNLIKELY if char in toxicity.LEET else toxicity.DROP_LIKELY
                options.append([*read, ("", drop)])
        best = max((sum(c for _, c in path) + model.word("".join(x for x, _ in path)),
                    "".join(x for x, _ in path)) for path in itertools.product(*options))
        assert restore.decode(word) == best[1]


@pytest.mark.parametrize("labels", ["none", "one kind"])
def test_models_without_labels_of_both_kinds(spark, labels):
    docs, known = labelled(spark, 40)
    known = known.limit(0) if labels == "none" else known.where("toxic = 0")
    bad = quality.quality_scores(docs, quality.fit_quality(docs, known)).select("score").distinct().collect()
    tox = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, known)).select("score").distinct().collect()
    assert len(bad) == 1 and len(tox) == 1
    assert bad[0].score >= 0.5 and tox[0].score <= 0.5
    empty = docs.limit(0)
    assert quality.quality_scores(empty, quality.fit_quality(empty, known)).count() == 0


def test_quality_defined_cases(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels)
    new = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "a b", 2.0), (3, "é" * 200_000, None)],
                                "doc_id long, text string, difference double")
    got = {r.doc_id: r for r in quality.quality_scores(new, model).collect()}
    assert got[1].score == got[2].score and 0 <= got[3].score <= 1 and got[None].held_out


def test_pipeline_stages(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    out = corpus_pipeline.run(spark, SMALL)
    assert set(docs.columns) < set(out.columns) and 0 < out.count() <= docs.count()
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, SMALL)
        assert kept.columns == docs.columns
        assert step(spark, docs.limit(0), SMALL).count() == 0
