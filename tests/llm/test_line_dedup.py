"""Line classes against all pairs of lines and a plain edit distance."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from skuweave.llm import line_dedup
from skuweave.llm.line_dedup import drop_duplicate_lines, line_report, within_edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def brute(rows, min_chars):
    """(doc_id, n_lines, dropped) with classes of lines at most one edit apart, transitively."""
    places = []
    for d, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        for i, raw in enumerate((text or "").split("\n")):
            line = raw.replace("\r", "").strip(" ")
            if len(line) >= min_chars:
                places.append((d, i, line))
    lines = sorted({p[2] for p in places})
    part = list(range(len(lines)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if abs(len(lines[i]) - len(lines[j])) < 2 and distance(lines[i], lines[j]) <= 1:
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    seen, dropped = set(), {}
    for d, i, line in places:
        c = root(lines.index(line))
        if c in seen:
            dropped.setdefault(d, []).append(i)
        seen.add(c)
    return sorted((d, len(t.split("\n")) if t else 0, dropped.get(d, [])) for d, t in rows)


def edited(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1:], line[:i] + rng.choice("abé") + line[i:],
                       line[:i] + rng.choice("abé") + line[i + 1:]])


def random_rows(seed, docs=60):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([9, 12, 15, 30]))) for _ in range(9)]
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(bases)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                line = edited(rng, line)
            lines.append(rng.choice(["", " "]) + line)
        rows.append((d, "\n".join(lines)))
    return rows


def report(docs, min_chars):
    return sorted((r.doc_id, r.n_lines, r.dropped) for r in line_report(docs, min_chars=min_chars).collect())


@pytest.mark.parametrize("seed,bucket", [(1, 16), (2, 2), (3, 1)])
def test_classes_against_all_pairs(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(line_dedup, "PAIRED_BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0 if bucket == 2 else 1000)
    rows = random_rows(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string")
    assert report(docs, 8) == brute(rows, 8)


def test_numbered_lines_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRED_BUCKET", 2)
    rows = [(d, f"This is line number {d % 10}{d // 10} of the book") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(docs, 20) == brute(rows, 20)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
        b = a
        for _ in range(rng.randint(0, 4)):
            b = edited(rng, b) if b else "a"
        if b:
            rows.append((a, b, distance(a, b) <= edits))
    df = spark.createDataFrame(rows, "x string, y string, want boolean")
    got = df.select("x", "y", "want", within_edits(F.col("x"), F.col("y"), edits).alias("close"))
    assert got.where("want <> close").collect() == []


def test_defined_cases(spark):
    long = "word " * 4000
    rows = [(1, None), (2, ""), (3, "short\nshort"), (4, "a line of some length here\nkeep me"),
            (5, "a line of some length here"), (6, long), (7, long), (7, long),
            (None, "a line of some length here\r\nmore")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = {(r.doc_id, r.n_lines): r.dropped for r in line_report(docs).collect()}
    assert got == {(1, 0): [], (2, 0): [], (3, 2): [], (4, 2): [], (5, 1): [0], (6, 1): [],
                   (7, 1): [0], (None, 2): [0]}
    kept = drop_duplicate_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:8]) for r in kept.collect()) == [
        (0, "more"), (1, ""), (2, ""), (3, "short\nsh"), (4, "a line o"), (6, "word wor")]
    assert line_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [16, 1])
def test_longer_lines_may_differ_more(spark, monkeypatch, bucket):
    monkeypatch.setattr(line_dedup, "PAIRED_BUCKET", bucket)
    rng = random.Random(bucket)
    bases = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (38, 41, 45, 61, 64, 83, 120)]
    bases += [bases[3][:30] + bases[4][:32], bases[5][:50] + bases[3][:33]]
    lines = []
    for _ in range(150):
        line = "x" + rng.choice(bases) + "x"
        for _ in range(rng.choice([0, 2, 3, 4, 5, 6])):
            line = edited(rng, line)
        lines.append(line)
    parts = {line: line for line in lines}

    def root(x):
        while parts[x] != x:
            x = parts[x]
        return x

    for a, b in combinations(lines, 2):
        most = max(1, min(3, min(len(a), len(b)) // 20))
        if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
            parts[root(b)] = root(a)
    seen, want = set(), []
    for d, line in enumerate(lines):
        want.append((d, 1, [0] if root(line) in seen else []))
        seen.add(root(line))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert report(docs, 20) == want
    single = line_report(docs, edits=1).where("n_dropped > 0").count()
    assert 0 < single < sum(len(w[2]) for w in want)


@pytest.mark.parametrize("t,k", [(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (2, 3)])
def test_every_pair_keeps_a_combination_of_segments(t, k):
    """Whatever t edits do, one of the planned combinations stands where it is looked for."""
    rng = random.Random(10 * t + k)
    plan = line_dedup.segment_plan(t, k, False) + line_dedup.segment_plan(t, k, True)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6 * (t + k), 9 * (t + k))))
        b = a
        for _ in range(t):
            b = edited(rng, b)
        if len(b) < len(a):
            a, b = b, a
        n, m = len(a), t + k

        def stands(entry):
            for s, o in zip(entry[2::2], entry[3::2]):
                start, end = s * n // m, (s + 1) * n // m
                if start + o < 0 or a[start:end] != b[start + o:end + o]:
                    return False
            return True

        assert any(e[1] == len(b) - n and stands(e) for e in plan)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_with_one_opening_are_not_paired(spark, monkeypatch, edits):
    """Many lines share an opening and go on differently: candidates don't grow with the square."""
    made = []
    compare = line_dedup.close_pairs
    monkeypatch.setattr(line_dedup, "close_pairs", lambda pairs, *rest: (
        made.append(pairs.count()), compare(pairs, *rest))[1])
    rng = random.Random(edits)
    opening = "this opening stands before every line "
    for n in (150,):
        made.clear()
        lines = [opening + "".join(rng.choice("abcdefgh") for _ in range(42)) for _ in range(n)]
        lines += [edited(rng, lines[0]), edited(rng, edited(rng, lines[1]))]
        docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        got = line_report(docs, edits=edits)
        assert {r.doc_id for r in got.where("n_dropped > 0").collect()} == (
            {n, n + 1} if edits > 1 else {n})
        assert sum(made) < 30 * n


def test_a_repeated_line_is_looked_for_once(spark, monkeypatch):
    """Copies of near lines sent their probes into the same buckets copy by copy."""
    line = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn"
    docs = spark.createDataFrame(
        [(i, line if i % 2 else line.replace("lazy dog", "lacy fog")) for i in range(60)],
        "doc_id long, text string")
    entered, real = [], line_dedup.segment_keys

    def counted(base, *args, **kwargs):
        entered.append(base.count())
        return real(base, *args, **kwargs)

    monkeypatch.setattr(line_dedup, "segment_keys", counted)
    report = line_report(docs).collect()
    assert set(entered) == {2}
    assert {r.doc_id: r.n_dropped for r in report} == {i: int(i > 0) for i in range(60)}


def test_a_line_sends_few_probes(spark):
    """Lengths that differ by a few characters share their segments, so a line is not sent once for each."""
    base = spark.createDataFrame([(n, "x" * n, n) for n in range(60, 260)], "lid long, line string, n int")
    probes = line_dedup.segment_keys(base, edits=3, per_edit=20, probes=True).count()
    assert probes < 12 * 200


def test_lines_within_edits_share_a_part(spark):
    """Near lines have one part of their pairs of characters in common; a number of other words leaves few."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(40)]
    line = " ".join(words)
    other = " ".join("".join(rng.choice("pqrstuvw") for _ in range(6)) if i % 4 == 0 else w
                     for i, w in enumerate(words))
    rows = [(0, line), (1, other)]
    for i in range(2, 60):
        near = line
        for _ in range(3):
            near = edited(rng, near)
        rows.append((i, near))
    texts = spark.createDataFrame(rows, "lid long, line string")
    for seed in (0, 1):
        marks = {}
        for r in line_dedup.pair_counts(texts, 3, seed).collect():
            marks.setdefault(r.lid, {})[r.part] = r.mark
        shared = {i: sum(marks[i][p] == m for p, m in marks[0].items()) for i in marks}
        assert all(len(m) == 13 for m in marks.values())
        assert min(n for i, n in shared.items() if i > 1) >= 1
        assert shared[1] <= 3


def test_lines_with_letters_put_in_are_not_paired(spark, monkeypatch):
    """Four letters put in at different places leave equal lengths and nearly equal pairs of characters."""
    made = []
    compare = line_dedup.close_pairs
    monkeypatch.setattr(line_dedup, "close_pairs", lambda pairs, *rest: (
        made.append(pairs.count()), compare(pairs, *rest))[1])
    rng = random.Random(7)
    base = " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(50))
    n = 160
    lines = []
    for i in range(n):
        at = 2 * i + 10
        lines.append(base[:at] + "".join(rng.choice("pqrstuvw") for _ in range(4)) + base[at:])
    lines += [edited(rng, lines[40]), edited(rng, edited(rng, edited(rng, lines[90])))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    dropped = {r.doc_id for r in line_report(docs).where("n_dropped > 0").collect()}
    assert {n, n + 1} <= dropped
    assert dropped == {j for j in range(n + 2) if any(
        abs(len(lines[i]) - len(lines[j])) <= 3 and distance(lines[i], lines[j]) <= 3 for i in range(j))}
    assert sum(made) < n * n // 6


@pytest.mark.parametrize("edits", [2, 3])
def test_sketches_let_near_lines_meet(spark, edits):
    """Whatever the edits are and wherever they stand, lengths and sketches don't part near lines."""
    rng = random.Random(edits)
    rows = []
    for i in range(400):
        a = "".join(rng.choice("abcé ") for _ in range(rng.choice([60, 61, 100, 300, 700])))
        b = a
        for _ in range(rng.randint(0, edits)):
            at = rng.choice([0, len(b) - 1, 39, 40, 55, rng.randrange(len(b))])
            b = rng.choice([b[:at] + b[at + 1:], b[:at] + rng.choice("xyé") + b[at:],
                            b[:at] + rng.choice("xyé") + b[at + 1:]])
        rows += [(2 * i, a), (2 * i + 1, b)]
    texts = spark.createDataFrame(rows, "lid long, line string")
    sketched = line_dedup.sketches(texts, edits)
    pairs = spark.range(400).selectExpr("2 * id as a", "2 * id + 1 as b")
    both = line_dedup._sketched(line_dedup._sketched(pairs, sketched, "a"), sketched, "b")
    near = both.where(f"least(n_a, n_b) >= {20 * edits}")
    assert near.where(f"NOT ({line_dedup.may_be_near(edits, 20)})").collect() == []
