"""Near-duplicate components against all pairs."""

import random

import pytest

from skuweave.llm import ngram_join
from skuweave.llm.ngram_join import drop_near_duplicates, near_duplicates


def brute(rows):
    def shingles(text):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for blank in "\t\n\v\f\r":
            folded = folded.replace(blank, " ")
        w = [x for x in folded.split(" ") if x]
        if len(w) < 5:
            return {tuple(w)} if w else set()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((d if d is not None else -1, len(sets[i]), least.get(root(i), -1))
                  for i, (d, _) in enumerate(rows))


def random_rows(seed, count=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 40, 90, 200]))]
             for _ in range(12)]
    rows = []
    for i in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(["Zz", "w1", "w2"])
        if rng.random() < 0.2:
            words += passage.split()
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "\t \n"), (903, "one"), (904, "ONE"),
                   (None, "one"), (903, "one"), (905, "É x"), (906, "é x")]


def got(docs):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles,
                   r.component_id if r.component_id is not None else -1)
                  for r in near_duplicates(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = random_rows(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    assert got(docs) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = random_rows(3, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
    kept = drop_near_duplicates(docs)
    ids = {d for d, _, c in brute(rows) if d == c}
    assert {r.doc_id if r.doc_id is not None else -1 for r in kept.collect()} == ids


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
