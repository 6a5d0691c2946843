"""Deduplication of lines, equal or a few edits apart, by segments."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, doc_key, free_name, stage, transient, whole

#: Lines this far apart are duplicates at any length; for these a line has 2 segments.
MAX_EDITS = 1

#: Longer lines may differ by one edit per PER_EDIT characters, up to EDITS (defaults).
EDITS, PER_EDIT = 3, 20

#: Buckets up to this size are listed and paired at once, larger ones are divided first.
PAIRED_BUCKET = 16

#: Behind how many characters two lines are cut to compare their heads and their tails.
CUTS = [int(40 * 1.4 ** i) for i in range(12)]

#: Line ids (8 bytes) and buckets (24) are broadcast up to this number; beyond, joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Where the missing id of a document stands in the order of documents: last.
NO_ID = (1 << 63) - 1


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, ord, line_no, line, lid, n): the trimmed lines long enough to be compared."""
    cut = F.split(F.regexp_replace(whole(text_col), "\r", ""), "\n")
    rows = docs.select(doc_key(id_col, text_col).alias("key"),
                       F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("ord"),
                       F.posexplode(F.transform(cut, lambda line: F.trim(line))).alias("line_no", "line"))
    return rows.select("*", F.xxhash64("line").alias("lid"), F.length("line").alias("n")).where(
        F.col("n") >= min_chars)


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def entries(text: Column, length: Column) -> Column:
    """Index entries of a line: array of struct(key, own, p, s, r).

    One edit in a line of two segments leaves one segment whole, and of the other, cut
    in two, one half; so it lies in one quarter and the rest is equal. A line is entered
    under its own length and, because an edit may make it longer, under the length one
    less (`own` false). p characters at the start and s at the end are hashed with the
    length and the quarter; r characters lie between (r + 1 in a longer line).
    """
    found = []
    for own in (True, False):
        size = length if own else length - 1
        half = F.floor(size / 2).cast("int")
        first = F.floor(half / 2).cast("int")
        third = half + F.floor((size - half) / 2).cast("int")
        edges = (F.lit(0), first, half, third, size)
        for quarter, (x, y) in enumerate(zip(edges, edges[1:])):
            key = F.xxhash64(size, F.lit(quarter), F.substring(text, F.lit(1), x),
                             F.right(text, size - y))
            found.append(F.struct(key.alias("key"), F.lit(own).alias("own"),
                                  x.cast("int").alias("p"), (size - y).cast("int").alias("s"),
                                  (y - x).cast("int").alias("r")))
    return F.array(*found)


def sizes_of(rows: DataFrame) -> DataFrame:
    """Buckets that can hold a pair: at least one line of the own length and two in all."""
    own = F.sum(F.col("own").cast("long"))
    return rows.groupBy("key").agg(own.alias("owns"), F.count("*").alias("members")).where(
        "owns >= 1 and members >= 2")


def pairs_of(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of small buckets, from (key, lid, own); a has the bucket's own length."""
    listed = rows.groupBy("key").agg(F.collect_list(F.struct("lid", "own")).alias("m"))
    pairs = F.expr("""flatten(transform(filter(m, a -> a.own), a -> transform(
        filter(m, b -> (b.own and a.lid < b.lid) or (not b.own and a.lid <> b.lid)),
        b -> struct(a.lid as a, b.lid as b))))""")
    return listed.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")


def within_edits(a: Column, b: Column, edits: int = MAX_EDITS, most: Column | None = None) -> Column:
    """Whether two texts are at most `edits` apart (or `most`, 1 to `edits`), by a banded bit-parallel automaton.

    Bit k of row d says that the part of `a` read so far can be made, with d edits, the
    part of `b` that is k - edits characters longer. The rows stand side by side in one number,
    and one step per character of `a` moves all diagonals of the band together. Which diagonals
    match at a character is worked out once per character, before the steps.
    """
    width = 2 * edits + 1
    band = (1 << width) - 1
    rows = [1 << edits]
    for _ in range(edits):
        rows.append((rows[-1] | rows[-1] << 1) & band)

    def packed(parts: list) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y),
                      [F.shiftleft(part, d * width) for d, part in enumerate(parts)])

    def matches(char: Column, i: Column, other: Column) -> Column:
        return sum([F.when(F.coalesce(F.get(other, i + (k - edits)) == char, F.lit(False)),
                           F.lit(1 << k)).otherwise(F.lit(0)) for k in range(1, width)],
                   F.when(F.coalesce(F.get(other, i - edits) == char, F.lit(False)),
                          F.lit(1)).otherwise(F.lit(0))).cast("long")

    def step(state: Column, match: Column) -> Column:
        old = [F.shiftright(state, d * width).bitwiseAND(F.lit(band)) for d in range(edits + 1)]
        new = [old[0].bitwiseAND(match)]
        for d in range(1, edits + 1):
            new.append(old[d].bitwiseAND(match).bitwiseOR(old[d - 1]).bitwiseOR(
                F.shiftright(old[d - 1], 1)).bitwiseOR(F.shiftleft(new[d - 1], 1)).bitwiseAND(
                F.lit(band)))
        return packed(new)

    def close(pair: Column) -> Column:
        start = F.lit(sum(row << d * width for d, row in enumerate(rows))).cast("long")
        found = F.transform(pair["a"], lambda char, i: matches(char, i, pair["b"]))
        def row(state: Column) -> Column:
            chosen = F.shiftright(state, edits * width)
            for d in range(1, edits) if most is not None else ():
                chosen = F.when(most == d, F.shiftright(state, d * width)).otherwise(chosen)
            return chosen

        last = F.aggregate(found, start, step, row)
        place = F.size(pair["b"]) - F.size(pair["a"]) + edits
        return F.when(place.between(0, 2 * edits), F.pmod(F.floor(
            last / F.pow(F.lit(2.0), place)), F.lit(2)) == 1).otherwise(False)

    chars = F.struct(*[F.regexp_extract_all(c, F.lit("(?s)."), 0).alias(n)
                       for c, n in ((a, "a"), (b, "b"))])
    return F.get(F.transform(F.array(chars), close), F.lit(0))


def near_pairs(lines: DataFrame) -> DataFrame:
    """Links (a, b) between different lines one edit apart that connect all such lines.

    lines: column `line`. Every pair one edit apart is in one bucket of the index. A
    small bucket is paired. In a large one, the part that may differ is cut in two again:
    lines one edit apart agree in one of the halves, so each line moves to two buckets
    with a longer hash, and lines that differ in more places part. Only large buckets go
    on, and when one character is left, its members are linked to their smallest line
    alone, because all are one edit from each other. Thus no group is paired with itself
    in full, and the lines reached are the same. All links are checked by characters.
    """
    lid = F.xxhash64("line")
    keys = entries(F.col("line"), F.length("line"))
    names = [f"key{i}" for i in range(8)]
    index = stage(
        lines.select(lid.alias("lid"), *[keys[i]["key"].alias(n) for i, n in enumerate(names)])
        .groupBy("lid").agg(*[F.first(n).alias(n) for n in names])
        .select("lid", F.posexplode(F.array(*names)).alias("place", "key"))
        .select("lid", "key", (F.col("place") < 4).alias("own")), "line-index")
    buckets = stage(sizes_of(index), "line-buckets")
    members = stage(index.join(buckets, "key"), "line-members")
    small = F.col("members") <= PAIRED_BUCKET
    pairs = [stage(pairs_of(members.where(small)), "line-pairs")]

    wanted = pairs[0].select(F.explode(F.array("a", "b")).alias("lid")).union(
        members.where(~small).select("lid")).distinct()
    wanted = stage(wanted, "lines-wanted")
    texts = lines.select(lid.alias("lid"), "line")
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted), "lid")
    else:
        texts = texts.join(wanted, "lid")
    texts = stage(texts.distinct(), "line-texts")

    rows = texts.select("lid", "line", F.inline(entries(F.col("line"), F.length("line")))).join(
        members.where(~small).select("key").distinct(), "key", "left_semi")
    rows = stage(rows, "large-buckets")
    while not rows.isEmpty():
        # Lines of the own length with one character between: one substitution apart.
        alone = rows.where("own and r = 1").select("key", "lid")
        # Nothing between: the one line of the own length, and lines with a character more.
        done = rows.where("r = 0").select("key", "lid", "own")
        star = alone.join(alone.groupBy("key").agg(F.min("lid").alias("a")), "key").select(
            "a", F.col("lid").alias("b")).union(
            done.where("not own").join(done.where("own").groupBy("key").agg(
                F.min("lid").alias("a")), "key").select("a", F.col("lid").alias("b")))
        pairs.append(stage(star.where("a <> b"), "line-stars"))
        cut = F.greatest(F.floor(F.col("r") / 2).cast("int"), F.lit(1))
        rest = F.greatest(F.col("r") - cut, F.lit(1))
        halves = F.array(
            F.struct(F.xxhash64("key", F.lit(0), F.substring("line", F.col("p") + 1, cut)).alias("key"),
                     "own", (F.col("p") + cut).alias("p"), "s", (F.col("r") - cut).alias("r")),
            F.struct(F.xxhash64("key", F.lit(1), F.substring(
                "line", F.length("line") - F.col("s") - rest + 1, rest)).alias("key"),
                "own", "p", (F.col("s") + rest).alias("s"), (F.col("r") - rest).alias("r")))
        deeper = stage(rows.where("r > 0").select("lid", "line", F.inline(halves)), "halves")
        known = stage(sizes_of(deeper), "half-sizes")
        deeper = deeper.join(known, "key")
        pairs.append(stage(pairs_of(deeper.where(small)), "line-pairs"))
        rows = stage(deeper.where(~small).select("lid", "line", "key", "own", "p", "s", "r"),
                     "large-buckets")

    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    named = texts.select("lid", F.col("line"))
    both = (found.distinct().join(named.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a")
            .join(named.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b"))
    # Few rows with much work each: dealt to all tasks, and compared by a generator, which
    # the optimizer leaves where it is.
    dealt = both.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    close = dealt.select("x", "y", F.explode_outer(F.array(
        within_edits(F.col("x"), F.col("y")))).alias("close")).where("close")
    return close.select(line_id(F.col("x")).alias("a"), line_id(F.col("y")).alias("b")).where("a <> b")


def segment_plan(t: int, k: int, probes: bool) -> list[tuple[int, ...]]:
    """Which `k` of the t + k segments of a line are hashed together, and where they are looked for.

    Each entry is (t, d, s1, o1, s2, o2, ...): in a line that is d characters longer, segment s
    is looked for o places on. Own entries have d = 0 and no shifts, probes are all the others.
    Of t + k segments, t edits leave k whole. They can be chosen so that between two of them (and
    before the first) there are as many edits as segments, and behind the last no more: count
    edits less segments from the left, and take the segments at which this falls below each of
    0, -1, ... for the last time. That bounds the shifts.
    """
    found = []
    for chosen in combinations(range(t + k), k):
        gaps = [chosen[0], *[b - a - 1 for a, b in zip(chosen, chosen[1:])]]
        paths = [()]
        for gap in gaps:
            paths = [(*path, (path[-1] if path else 0) + o) for path in paths
                     for o in range(-gap, gap + 1)]
        behind = t + k - 1 - chosen[-1]
        for path in paths:
            for d in range(t + 1):
                if abs(d - path[-1]) <= behind and (d > 0 or any(path)) == probes:
                    found.append((t, d, *[x for pair in zip(chosen, path) for x in pair]))
    return found


def allowed(length: str, edits: int, per_edit: int) -> str:
    """SQL: the edits that a line of this length allows."""
    return f"cast(least({edits}, {length} div {per_edit}) as int)"


def segment_length(size: str, t: int | str) -> str:
    """SQL: the length of each of the t + 1 segments of a line, rounded down by up to an eighth.

    Lines that differ by a few characters then nearly always have segments of one length.
    """
    return f"({size} div ({t} + 1) - ({size} div ({t} + 1)) % greatest({size} div ({t} + 1) div 8, 1))"


def segment_places(edits: int, probes: bool) -> list[tuple[int, int, int, int, int]]:
    """(t, before, d, s, o): segment s of t + 1 is looked for o places on in a line d longer.

    `before` is the next smaller d with the same s and o, own entries included, or -1.
    """
    plans = [entry for t in range(MAX_EDITS + 1, edits + 1)
             for own in (False, True) for entry in segment_plan(t, 1, own)]
    known = set(plans)
    return [(t, d - 1 if (t, d - 1, s, o) in known else -1, d, s, o)
            for t, d, s, o in plans if (d > 0 or o != 0) == probes]


def segment_keys(base: DataFrame, edits: int, per_edit: int, probes: bool) -> DataFrame:
    """Index entries (key, lid) of lines (lid, line, n): own ones, or probes.

    The places are a constant table that is put next to every line; those for another number of
    edits than the (shorter) length allows are dropped at once, and of those that differ in the
    shorter length only, the ones whose segments have the same length: their key is the same.
    What lies behind the last segment counts as its part but is not hashed.
    """
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "e", "d", "s", "o"), entry)])
                       for entry in segment_places(edits, probes)])
    rows = base.select("lid", "line", "n", F.inline(places)).where(
        f"n - d >= {2 * per_edit} AND t = {allowed('(n - d)', edits, per_edit)}")
    rows = rows.where(f"e < 0 OR t <> {allowed('(n - e)', edits, per_edit)} OR "
                      f"{segment_length('(n - e)', 't')} <> {segment_length('(n - d)', 't')}")
    rows = rows.withColumn("size", F.expr(f"cast({segment_length('(n - d)', 't')} as int)"))
    return rows.select(F.expr("xxhash64(t, s, substring(line, s * size + o + 1, size))").alias("key"), "lid")


def limited(df: DataFrame) -> DataFrame:
    """A broadcast of a staged table if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(lid) of the lines that stand in several places."""
    return limited(stage(lines.groupBy("lid").agg(F.count("*").alias("places")).where(
        "places > 1").select("lid"), "lines-repeated"))


def distinct_lines(lines: DataFrame, several: DataFrame) -> DataFrame:
    """(lid, line, n), one row per line. Of the texts, only those of repeated lines are shuffled."""
    once = stage(lines.join(several, "lid", "left_semi").groupBy("lid").agg(
        F.first("line").alias("line")), "lines-once")
    return lines.join(several, "lid", "left_anti").select("lid", "line", "n").union(
        once.select("lid", "line", F.length("line").alias("n")))


def texts_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, line) of the wanted line ids, one row each. Only their texts are shuffled."""
    wanted = limited(stage(wanted.select("lid").distinct(), "lines-wanted"))
    return stage(base.select("lid", "line").join(wanted, "lid").groupBy("lid").agg(
        F.first("line").alias("line")), "line-texts")


def close_pairs(pairs: DataFrame, base: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """The pairs (a, b) of lines that are within the edits that the shorter one allows: (a, b, x, y).

    x and y are the lines. Few rows with much work each: dealt to all tasks. Pairs without enough
    whole segments in common go first; of the others, what is equal at both ends is left out,
    and the rest is compared by a generator, which the optimizer leaves where it is.
    """
    pairs = stage(pairs, "line-candidates")
    texts = texts_of(base, pairs.select(F.explode(F.array("a", "b")).alias("lid")))
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    most = F.expr(allowed("least(length(x), length(y))", edits, per_edit))
    dealt = both.where(F.abs(F.length("x") - F.length("y")) <= most).repartition(
        int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = within_edits(F.col("p"), F.col("q"), edits, most)
    cut = dealt.where(enough_segments(edits)).withColumn("at", _alike("x", "y", F.left)).select(
        "a", "b", "x", "y", F.expr("substring(x, at + 1)").alias("p"),
        F.expr("substring(y, at + 1)").alias("q")).withColumn("at", _alike("p", "q", F.right)).select(
        "a", "b", "x", "y", F.expr("left(p, length(p) - at)").alias("p"),
        F.expr("left(q, length(q) - at)").alias("q"))
    return cut.select("a", "b", "x", "y", F.explode_outer(F.array(near)).alias("close")).where(
        "close").select("a", "b", "x", "y")


def enough_segments(t: int, more: int = 14) -> str:
    """SQL: of t + `more` segments of x, `more` at least stand in y, at most t places away.

    True wherever y is within t edits of x, as each edit breaks one segment at most.
    """
    found = []
    for i in range(t + more):
        start, end = (f"({i + k} * length(x) div {t + more})" for k in (0, 1))
        begin = f"greatest({start} - {t}, 0)"
        found.append(f"cast(contains(substring(y, cast({begin} + 1 as int), "
                     f"cast({end} + {t} - {begin} as int)), substring(x, cast({start} + 1 as int), "
                     f"cast({end} - {start} as int))) as int)")
    return f"{' + '.join(found)} >= {more}"


def _alike(x: str, y: str, side) -> Column:
    """How many characters two different texts have in common at the start (F.left) or end."""
    steps = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        side(F.col(x), n + step) == side(F.col(y), n + step), n + step).otherwise(n))


def sketches(texts: DataFrame, edits: int, seed: int = 0) -> DataFrame:
    """(lid, n, m0, ..., total, heads): the pairs of neighbouring characters of a line, as bits that say
    whether they have met an odd number of pairs.

    m: 4 * edits + 1 parts of 16 bits, four parts a number, to which the pairs are dealt. An edit takes
    two pairs away and brings two at most, so that lines `edits` apart differ in 4 * edits bits at
    most, however long they are. total: all pairs in 64 bits; heads: those before each of `CUTS`.
    """
    parts, chars = 4 * edits + 1, "(?s).."
    rows = texts.select("lid", F.length("line").alias("n"), F.posexplode_outer(F.concat(
        F.regexp_extract_all("line", F.lit(chars), 0),
        F.regexp_extract_all(F.expr("substring(line, 2)"), F.lit(chars), 0))).alias("i", "two"))
    rows = rows.select("lid", "n", F.expr("if(i < n div 2, 2 * i, 2 * (i - n div 2) + 1)").alias("place"),
                       F.xxhash64("two", F.lit(seed)).alias("hash"))
    rows = rows.select("lid", "n", "place", F.expr(f"pmod(hash, {parts})").alias("part"), F.expr(
        "shiftleft(1L, cast(shiftright(hash, 34) & 63 as int))").alias("bit"), F.expr(
        "cast(shiftright(hash, 40) & 15 as int)").alias("small"))
    marks = [F.expr(f"bit_xor(CASE WHEN part div 4 = {word} THEN shiftleft(1L, cast(part % 4 * 16 as int) + small) "
                    f"ELSE 0L END)").alias(f"m{word}") for word in range(edits + 1)]
    heads = [F.expr(f"bit_xor(CASE WHEN place < {cut} THEN bit ELSE 0L END)") for cut in CUTS]
    return rows.groupBy("lid").agg(F.first("n").alias("n"), *marks, F.expr(
        "coalesce(bit_xor(bit), 0L)").alias("total"), F.array(*heads).alias("heads"))


def _mark(part: int, number: str) -> str:
    """SQL: a part of a sketch; number: how its numbers are named, with {} for which one."""
    return f"shiftright({number.format(part // 4)}, {part % 4 * 16}) & 65535"


def pair_counts(texts: DataFrame, edits: int, seed: int = 0) -> DataFrame:
    """(lid, part, mark): the parts of the `sketches`; texts: (lid, line), or sketches.

    Lines within `edits` of each other have a part in common, as there is one part more than bits
    in which they differ.
    """
    sketched = texts if "m0" in texts.columns else sketches(texts, edits, seed)
    marks = [F.expr(_mark(part, "m{}")) for part in range(4 * edits + 1)]
    return sketched.select("lid", F.posexplode(F.array(*marks)).alias("part", "mark"))


def may_be_near(edits: int, per_edit: int) -> str:
    """SQL: lengths and sketches of two lines (n_a, m0_a, ... and n_b, ...) allow them to be near.

    Where both lines are cut behind as many characters, the pairs of their heads and those of their
    tails differ in 4 bits for each edit and in 1 for each character of difference in length: an edit that
    moves the rest by one character changes three pairs and carries one over the cut. So lines with
    something put in at different places differ by what the cuts between those places carry over.
    """
    most = allowed("least(n_a, n_b)", edits, per_edit)
    apart = " + ".join(f"bit_count(m{i}_a ^ m{i}_b)" for i in range(edits + 1))
    cuts = ("forall(zip_with(heads_a, heads_b, (x, y) -> x ^ y), z -> bit_count(z) + "
            f"bit_count(z ^ total_a ^ total_b) <= 4 * {most} + abs(n_a - n_b))")
    return f"abs(n_a - n_b) <= {most} AND {apart} <= 4 * {most} AND {cuts}"


def _sketched(rows: DataFrame, sketched: DataFrame, side: str) -> DataFrame:
    """The rows with the sketch (n_<side>, m0_<side>, ...) of the line in column <side>."""
    names = [c for c in sketched.columns if c != "lid"]
    return rows.join(sketched.select(F.col("lid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names]),
                     side)


def far_pairs(base: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Links (a, b) of line ids that connect all lines within the edits that the shorter one allows.

    base: (lid, line, n), lines that allow two edits or more, each once: repeated ones would send
    their probes again and again into the same buckets; `near_pairs` has the shorter ones. Own
    entries are counted by bucket, and of the probes only those go on that meet another line's
    entry; both are 16 bytes a row. Of the texts, those of lines that met another are
    written once. A bucket with few own lines is paired with its probes. In one with many, all lines
    are compared with its smallest own line; where all are close to it, that connects them, and the
    bucket is done. The lines of the other large buckets are divided, each once for all its buckets, by
    their lengths and by what they have in common all over the line (`pair_counts`), by which lines
    part that agree in long pieces only. A near pair stays together in one part at least, and
    is paired in the first. What is then still in large buckets is paired but for lines that are
    both near the smallest.
    Pairs whose lengths or `sketches` are too far apart are no candidates, wherever they meet.
    """
    owns = segment_keys(base, edits, per_edit, probes=False)
    stats = owns.groupBy("key").agg(
        F.count("*").alias("owns"), F.min("lid").alias("first"), F.max("lid").alias("last"))
    met = segment_keys(base, edits, per_edit, probes=True).join(stats, "key").where(
        "first <> last OR first <> lid").select("key", "owns", "first", "last", "lid")
    hits = stage(met.union(stats.where("first <> last").select(
        "key", "owns", "first", "last", F.lit(None).cast("long"))), "segment-hits")
    alone = hits.where("first = last").select(F.col("first").alias("a"), F.col("lid").alias("b")).distinct()
    several = limited(hits.where("lid IS NULL").select("key", "owns", "first"))
    rows = stage(owns.join(several, "key").select("key", "lid", F.lit(True).alias("own"), "owns", "first").union(
        hits.where("first <> last AND lid IS NOT NULL").select(
            "key", "lid", F.lit(False), "owns", "first")).distinct(), "segment-rows")
    texts = texts_of(base, alone.select(F.explode(F.array("a", "b")).alias("lid")).union(rows.select("lid")))
    sketched = limited(stage(sketches(texts, edits), "line-sketches"))

    def alike(pairs: DataFrame) -> DataFrame:
        return _sketched(_sketched(pairs, sketched, "a"), sketched, "b").where(
            may_be_near(edits, per_edit)).select("a", "b")

    found = [alike(alone)]
    rows = rows.withColumn("part", F.lit(0))
    for divided in (False, True):
        few = rows.where(F.col("owns") <= PAIRED_BUCKET).withColumn("near", F.lit(False))
        found.append(_own_pairs(few, sketched, edits, per_edit))
        large = rows.where(F.col("owns") > PAIRED_BUCKET)
        if large.isEmpty():
            break
        tried = stage(alike(large.where("lid <> first").select(
            F.col("first").alias("a"), F.col("lid").alias("b")).distinct()), "segment-tried")
        if not tried.isEmpty():
            tried = stage(close_pairs(tried, texts, edits, per_edit).select("a", "b"), "segment-stars")
            found.append(tried)
        close = tried.select(F.col("a").alias("first"), F.col("b").alias("lid"), F.lit(True).alias("near"))
        marked = stage(large.join(close, ["first", "lid"], "left").withColumn(
            "near", F.coalesce("near", F.col("lid") == F.col("first"))), "segment-marked")
        pending = marked.join(marked.where("NOT near").select("key").distinct(), "key", "left_semi")
        if divided:
            found.append(_own_pairs(pending, sketched, edits, per_edit))
            break
        lines = sketched.join(pending.select("lid").distinct(), "lid", "left_semi")
        # The longer line of a pair finds the length of the shorter one.
        shorter = F.explode(F.array(*[F.lit(d) for d in range(edits + 1)])).alias("d")
        parts = stage(pair_counts(lines, edits).join(lines.select("lid", "n"), "lid").select(
            "lid", "part", "mark", "n", shorter).select(
            F.expr("xxhash64(n - d, part, mark)").alias("key"), "lid", F.expr("d = 0").alias("own"), "part"),
            "segment-parts")
        mine = F.when(F.col("own"), F.col("lid"))
        sizes = stage(parts.groupBy("key").agg(
            F.count(mine).alias("owns"), F.min(mine).alias("first"), F.min("lid").alias("x"),
            F.max("lid").alias("y")).where("owns > 0 AND x <> y").select("key", "owns", "first"), "part-sizes")
        rows = stage(parts.join(sizes, "key").select("key", "lid", "own", "owns", "first", "part"), "segment-rows")
    pairs = reduce(DataFrame.union, [f.select("a", "b") for f in found]).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return close_pairs(pairs, texts, edits, per_edit).select(
        line_id(F.col("x")).alias("a"), line_id(F.col("y")).alias("b"))


def _own_pairs(rows: DataFrame, sketched: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Each own line of a bucket with each other row of it that may be near.

    Lines that are both near go without, and of several parts that two lines have in common, the first
    has them.
    """
    a = _sketched(rows.where("own").select(
        "key", F.col("lid").alias("a"), F.col("near").alias("near_a"), "part"), sketched, "a")
    b = _sketched(rows.select("key", F.col("lid").alias("b"), F.col("near").alias("near_b"),
                              F.col("own").alias("own_b")), sketched, "b")
    first = " AND ".join(f"(part <= {i} OR {_mark(i, '(m{0}_a ^ m{0}_b)')} <> 0)" for i in range(4 * edits + 1))
    return a.join(b, "key").where(
        "a <> b AND NOT (near_a AND near_b) AND (a < b OR NOT own_b) AND "
        f"{first} AND {may_be_near(edits, per_edit)}").select("a", "b")


def line_links(lines: DataFrame, several: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Links (a, b) between line ids that connect all near lines; lines: (line, lid, n).

    several: (lid) of the repeated ones.

    Where lines may differ in two places or more, those go by longer segments; the others, and
    lines of one character more, are compared with one edit.
    """
    if edits <= MAX_EDITS:
        return near_pairs(lines.select("line"))
    short = near_pairs(lines.where(F.col("n") <= 2 * per_edit).select("line"))
    base = distinct_lines(lines.where(F.col("n") >= 2 * per_edit).select("lid", "line", "n"), several)
    return short.union(far_pairs(base, edits, per_edit))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_chars: int = 20, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """Lines to drop: (key, line_no, first_ord), key as in `doc_key`.

    Lines are cut at line feeds and trimmed; those of at least `min_chars` characters are
    compared. Two lines are near when they are at most one edit apart, or as many as the
    shorter one has whole `per_edit` (2 or more) characters, up to `edits`. Lines that are
    equal, or joined by a chain of near lines, are one class; its first line stays, in
    order of id (missing ids last), then key, then position.

    Classes meet in joins on the line's hash, which AQE splits where a line is in very
    many documents. NULL and empty texts have no lines to compare; rows that repeat id
    and text are one document. Only the two named columns are read.
    """
    with transient(docs.sparkSession) as keep:
        # Written once: texts are cut into lines here only, and don't move.
        lines = stage(lines_of(docs, id_col, text_col, min_chars), "lines", compression="zstd")
        several = repeated_lines(lines)
        roots = stage(components(line_links(lines, several, edits, per_edit), name="line-classes").select(
            F.col("node").alias("line"), F.col("root")), "line-roots")
        # A line that stands once and is near no other is alone in its class.
        placed = lines.select("key", "ord", "line_no", "lid", line_id(F.col("line")).alias("line")).join(
            several.withColumn("again", F.lit(True)), "lid", "left").join(
            limited(roots), "line", "left").where("again OR root IS NOT NULL")
        placed = stage(placed.select("key", "ord", "line_no", F.coalesce("root", "line").alias("class"))
                       .distinct(), "line-places")
        place = F.struct("ord", "key", "line_no")
        # Written before the join, so that the lines of a hot class are split.
        classes = stage(placed.groupBy("class").agg(
            F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(
            F.col("class").alias("c"), "first"), "line-firsts")
        return keep(stage(placed.join(classes, F.col("class") == F.col("c")).where(
            place != F.col("first")).select(
            "key", "line_no", F.col("first.ord").alias("first_ord")), "lines-dropped"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, edits: int = EDITS,
                per_edit: int = PER_EDIT) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, dropped (positions of dropped lines)."""
    dropped = duplicate_lines(docs, id_col, text_col, min_chars, edits, per_edit).groupBy("key").agg(
        F.sort_array(F.collect_list("line_no")).alias("dropped"))
    rows = docs.select(F.col(id_col), doc_key(id_col, text_col).alias("key"), F.when(
        whole(text_col) == "", 0).otherwise(F.size(F.split(whole(text_col), "\n"))).alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(dropped, "key", "left").select(
        id_col, "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_chars: int = 20, edits: int = EDITS,
                         per_edit: int = PER_EDIT) -> DataFrame:
    """The documents without their duplicate lines, all columns.

    A document keeps its other lines in order. One that had lines and loses all of them is
    left out, as its lines stand elsewhere; a text without comparable lines is unchanged.
    """
    key, gone, left = (free_name(docs, n) for n in ("_key", "_dropped", "_left"))
    dropped = duplicate_lines(docs, id_col, text_col, min_chars, edits, per_edit).groupBy(
        F.col("key").alias(key)).agg(F.collect_set("line_no").alias(gone))
    rows = docs.join(dropped, doc_key(id_col, text_col) == F.col(key), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"),
                    lambda line, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return (rows.withColumn(left, text)
            .where(F.col(gone).isNull() | (F.trim(F.col(left)) != ""))
            .select(*[F.col(left).alias(c) if c == text_col else F.col(f"`{c}`")
                      for c in docs.columns]))
