"""Removed bytes against a count of all strings."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuweave.llm import repeats
from skuweave.llm.repeats import without_repeats


def brute(rows, length):
    count = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        count.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if count[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d if d is not None else -1, len(raw), sum(gone), spans,
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(docs, length):
    rows = without_repeats(docs, length=length).select(
        F.coalesce("doc_id", F.lit(-1)).alias("d"), "n_bytes",
        F.expr("aggregate(removed, 0L, (n, r) -> n + r.b - r.a)").alias("gone"),
        F.size("removed").alias("spans"), F.sha2("kept", 256).alias("sha"))
    return sorted(tuple(r) for r in rows.collect())


def random_rows(seed, letters="ab cé\0", docs=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 120))) for _ in range(6)]
    rows = []
    for d in range(docs):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else
                       "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
                       for _ in range(rng.randint(0, 5)))
        rows.append((d, text))
    return rows + [(900, None), (901, ""), (902, "a" * 900), (903, "ab" * 40), (904, "xyz" * 200),
                   (None, rows[3][1]), (905, rows[4][1]), (905, rows[4][1])]


@pytest.mark.parametrize("seed,length,shard,rows", [
    (1, 20, 3 << 20, 1_500_000), (2, 33, 500, 1_500_000), (3, 20, 200, 0)])
def test_against_counting_all_strings(spark, monkeypatch, seed, length, shard, rows):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(repeats, "PIECE", 256)
    data = random_rows(seed)
    docs = spark.createDataFrame([(d, t, "k") for d, t in data], "doc_id long, text string, key string")
    assert got(docs, length) == brute(data, length)


def test_long_texts_and_no_rows(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    data = [(1, long), (2, long[100:5_000] + "tail"), (3, "x" + long[59_000:])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert got(docs, 200) == brute(data, 200)
    assert without_repeats(docs.limit(0)).count() == 0


def test_equal_segments_have_equal_hashes():
    """Wherever they stand: else no two copies of a segment would be taken as one."""
    rng = random.Random(3)
    passage = bytes(rng.randrange(256) for _ in range(3000))
    anchors = repeats.Anchors(200)
    found = []
    for lead in (0, 17, 5000):
        text = bytes(rng.randrange(256) for _ in range(lead)) + passage
        _, first, anchor, content = anchors.segments([text])
        inner = [(a, c) for f, a, c in zip(first[1:-1], anchor[1:-1], content[1:-1]) if f > lead + 400]
        found.append(inner[:5] if lead else inner)
    assert set(found[1]) <= set(found[0]) and set(found[2]) <= set(found[0]) and found[1]


@pytest.mark.parametrize("seed", range(6))
def test_marked_windows_against_all_windows(seed):
    """Every window that stands twice is marked, and only such windows end up in the runs."""
    rng = random.Random(seed)
    length = rng.choice([1, 2, 7, 20])
    base = bytes(rng.choice(b"ab") for _ in range(60))
    bodies = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 70))) for _ in range(30)]
    bodies += [base[rng.randrange(30):][:rng.randrange(60)] for _ in range(10)]
    bodies = [b for b in dict.fromkeys(bodies) if len(b) >= length]
    counts = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    want = [{i for i in range(len(b) - length + 1) if counts[b[i:i + length]] > 1} for b in bodies]
    marked = [set() for _ in bodies]
    for of, first, last in repeats.marked_ranges(bodies, length):
        marked[of] |= set(range(first, last + 1))
    assert marked == want
    found = repeats.repeated_starts(bodies, np.ones(len(bodies), int), length)
    assert [{i for a, b in runs for i in range(a, b + 1)} for runs in found] == want


def test_a_task_holds_little_at_once():
    """A piece is hashed and a shard is searched in some tens of MB: two tasks share an executor's rest."""
    raw = np.random.default_rng(5).integers(97, 120, repeats.SHARD_BYTES, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        repeats.Anchors(200).segments([raw[:repeats.PIECE]])
        hashed = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        repeats.marked_ranges([raw[i:i + 400] for i in range(0, len(raw), 400)], 200)
        searched = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(hashed, searched)
    assert hashed < 50 << 20 and searched < 150 << 20
