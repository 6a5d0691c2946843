"""Exact dedup, mixing, URL filter and decontamination: SQL, brute force and defined cases."""

import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oracle_check import connect, differences
from skuweave.llm import decontaminate, exact_dedup, mixing, url_filter
from skuweave.llm.queries import ORACLES, QUERIES, URL_RULES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), ORACLES[name], connect(SMALL)) == ""


def by_id(df, *columns, id_col="doc_id"):
    return {r[id_col]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "ABC é"), (4, "abc é"), (5, "abc É"), (6, "x"), (6, "x"), (None, "x")]
    docs = spark.createDataFrame([(d, t, 0, "s") for d, t in rows], "doc_id long, text string, h int, sha string")
    got = by_id(exact_dedup.exact_duplicates(docs, keep="largest"), "keep_id", "group_size", "kept")
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True),
                   5: (5, 1, True), 6: (6, 3, True), None: (6, 3, False)}
    least = exact_dedup.drop_exact_duplicates(docs)
    assert least.columns == docs.columns
    assert {r.doc_id for r in least.collect()} == {1, 3, 5, 6}
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """The resharing as stated: cut at the caps and share the excess again until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, pot = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while free and pot > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += pot * weight[s] / total
        pot = sum(max(0.0, target[s] - cap * sizes[s]) for s in free)
        full = {s for s in free if target[s] >= cap * sizes[s]}
        for s in full:
            target[s] = float(cap * sizes[s])
        free -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_resharing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 2, 9, 60])), rng.choice(["b", "a", "é", None, "Z"][:rng.randint(1, 5)]))
            for i in range(150)]
    rows += [(500, None, "a"), (501, "", "only empty"), (None, "x y", "a"), (3, "again", "a"), (3, "again", "a")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, target string")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = targets(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[source], abs=1e-6)
        largest = max(sum(r["size"] for r in own if r.doc_id == d) for d in {r.doc_id for r in own})
        assert abs(sum(r.taken for r in own) - want[source]) <= largest / 2 + 1e-6
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)
    kept = mixing.mix(docs)
    assert sorted(kept.columns) == sorted([*docs.columns, "copies"])
    assert kept.agg(F.sum("copies")).first()[0] == sum(r.copies for r in got)
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_url_defined_cases(spark):
    link = '<a href="http://bad.net/x">'
    rows = [(1, "http://A.Example.ORG/es/1?q", None), (2, "http://example.org/en/12", ""), (3, None, link),
            (4, "no scheme", link), (5, "x://bad.net", None), (6, "http://linker.net/a#b", link * 3),
            (7, "http://far.net/", '<img src=//linker.net/i.png>'), (8, "http://b.com/de/", None),
            (9, "http://org/", None), (9, "http://notorg/", None)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    rules = [*URL_RULES, ("block", "bad.net", "")]
    got = by_id(url_filter.url_verdicts(pages.where("url <> 'http://notorg/' or url is null"), rules), "host", "path",
                "rule", "verdict", id_col="page_id")
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("", "", None, "allow"),
        4: ("", "", None, "allow"), 5: ("bad.net", "", "bad.net", "block"),
        6: ("linker.net", "/a", None, "block"), 7: ("far.net", "/", None, "block"),
        8: ("b.com", "/de/", "com/de/", "block"), 9: ("org", "/", "org/", "allow")}
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


def test_masks_leave_no_window_out():
    window, masks = decontaminate.WINDOW, decontaminate.MASKS
    places = [{o + p for p in mask} for mask in masks for o in range(window - max(mask))]
    for bad in combinations(range(window), window - decontaminate.LEAST_EQUAL):
        assert any(not place & set(bad) for place in places)


def leaking(rows, items):
    import regex

    def tokens(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    found = set()
    for d, text in rows:
        doc = tokens(text)
        for i, item in items:
            item = tokens(item)
            for shift in range(-len(item), len(doc)):
                equal = [0 <= shift + j < len(doc) and doc[shift + j] == t for j, t in enumerate(item)]
                if any(sum(equal[s:s + 13]) >= 11 for s in range(len(item) - 12)):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_leaks_against_all_alignments(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(7)
    vocabulary = ["the", "of", *[f"w{i}" for i in range(40)]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 13, 20, 40])))) for i in range(15)]
    rows = []
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            part = part[rng.randint(0, 3):][:rng.choice([12, 13, 15, 40])]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "changed"
            words[len(words) // 2:len(words) // 2] = part
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper()))
    rows += [(90, None), (91, ""), (None, items[-1][1] + " " + items[0][1]), (92, rows[5][1]), (92, rows[5][1])]
    items += [(90, None), (91, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, item string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaking_items(docs, benchmark).collect()}
    want = leaking(rows, items)
    assert got == want and 5 < len(want)
    kept = decontaminate.drop_leaking(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_no_module_of_the_library_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "skuweave"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
