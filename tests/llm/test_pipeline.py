"""Each stage of the pipeline against a plain version, on the documents that the stage before has kept."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skuweave.llm import toxicity
from skuweave.llm.common import table
from skuweave.llm.queries import OP5_SQL
from test_filters import leaking
from test_line_dedup import distance
from test_ngram_join import brute as components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """The documents, and what each stage makes of what the one before has kept."""
    docs = table(spark, SMALL, "documents")
    found = [docs]
    for name, step in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.stage(step(spark, found[-1], SMALL), name.replace(" ", "-")))
    return found


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def near_lines(lines):
    """Pairs of lines within the edits that the shorter one allows, all pairs looked at.

    Characters that one line has more often than the other bound the distance from below; what is
    within that bound is compared in full.
    """
    letters = {c: i for i, c in enumerate(sorted(set("".join(lines))))}
    counts = np.zeros((len(lines), len(letters)), np.int16)
    for i, line in enumerate(lines):
        for c in line:
            counts[i, letters[c]] += 1
    sizes = np.array([len(x) for x in lines])
    for i in range(len(lines)):
        bound = np.abs(counts[i + 1:] - counts[i]).sum(1)
        most = np.maximum(1, np.minimum(3, np.minimum(sizes[i + 1:], sizes[i]) // 20))
        close = (bound <= 2 * most) & (np.abs(sizes[i + 1:] - sizes[i]) <= most)
        for j in np.flatnonzero(close) + i + 1:
            if distance(lines[i], lines[j]) <= max(1, min(3, min(sizes[i], sizes[j]) // 20)):
                yield i, j


def without_lines(rows):
    places = [(d, i, raw.replace("\r", "").strip(" ")) for d, text in rows
              for i, raw in enumerate((text or "").split("\n"))]
    places = [p for p in places if len(p[2]) >= 20]
    lines = sorted({p[2] for p in places})
    part = list(range(len(lines)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j in near_lines(lines):
        part[max(root(i), root(j))] = min(root(i), root(j))
    number, seen, gone = {x: k for k, x in enumerate(lines)}, set(), {}
    for d, i, line in sorted(places, key=lambda p: p[:2]):
        c = root(number[line])
        if c in seen:
            gone.setdefault(d, set()).add(i)
        seen.add(c)
    out = []
    for d, text in rows:
        left = text if d not in gone else "\n".join(
            x for i, x in enumerate(text.split("\n")) if i not in gone[d])
        if d not in gone or left.strip(" "):
            out.append((d, left))
    return out


def test_toxicity(spark, outputs):
    docs, kept = outputs[:2]
    model = toxicity.fit_toxicity(docs, table(spark, SMALL, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, model).collect()}
    assert rows_of(kept) == [(d, t) for d, t in rows_of(docs) if scores[d] < 0.5]
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    left = {d for d, _ in rows_of(kept)}
    right = sum((labels[d] == 0) == (d in left) for d in labels)
    assert right >= 0.8 * len(labels)  # few labels at this size; test_classifiers has the larger one


def test_line_dedup(outputs):
    assert rows_of(outputs[2]) == without_lines(rows_of(outputs[1]))
    assert outputs[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicates(outputs):
    rows = rows_of(outputs[2])
    least = [d for d, n, component in components(rows) if not n or d == component]
    assert [d for d, _ in rows_of(outputs[3])] == least


def test_decontamination(spark, outputs):
    rows = rows_of(outputs[3])
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    found = {hit[0] for hit in leaking(rows, items)}
    assert rows_of(outputs[4]) == [r for r in rows if r[0] not in found]


def test_mixing(outputs):
    documents = outputs[4].toPandas()  # noqa: F841  read by the SQL
    want = {r[0]: r[1] for r in duckdb.connect().execute(
        f"SELECT doc_id, copies FROM ({OP5_SQL}) WHERE copies > 0").fetchall()}
    assert {r.doc_id: r.copies for r in outputs[5].collect()} == want
