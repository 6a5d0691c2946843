"""Near-duplicate documents by the Jaccard similarity of their word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, doc_key, free_name, stage, transient, whole

#: A block of documents that is compared at once has at most so many shingles or documents.
BLOCK_SHINGLES, BLOCK_DOCS = 400_000, 1_000

#: Assignments of documents are broadcast up to this number of rows; beyond, they are joined.
BROADCAST_ROWS = 1_000_000

#: Documents whose sizes differ at most by 4/3 are in the same or in neighbouring classes.
CLASS_BASE = 1.34


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit numbers.

    A-Z is folded and words are runs of bytes other than blanks; every word has a hash
    (`remember` of them are kept), a shingle is a mix of its words' hashes. A text with
    fewer words than a shingle is one shingle. Two shingles of two compared texts would
    have to collide in 64 bits to change an intersection by one.
    """

    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                        0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                        0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

    class Words(dict):
        def __missing__(self, word: bytes) -> int:
            import xxhash

            value = self[word] = xxhash.xxh64_intdigest(word)
            return value

    def __init__(self, words: int = 5, remember: int = 500_000):
        self.words, self.remember, self.known = words, remember, self.Words()

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        parts = (text or "").encode("utf-8", "replace").lower().split()
        if not parts:
            return np.empty(0, np.uint64)
        if len(parts) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(parts), len(parts))], np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, parts), np.uint64, len(parts))
        count = len(hashes) - self.words + 1
        mixed = hashes[:count] * self.FACTORS[0]
        for i in range(1, self.words):
            mixed += hashes[i:count + i] * self.FACTORS[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= self.FACTORS[5]
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def least_common(n: int) -> int:
    """Shingles that a set of n must share with any similar set: three quarters, rounded up."""
    return (3 * n + 3) // 4


def guaranteed(n: int) -> int:
    """Common shingles that a prefix is long enough to hold."""
    return min(8 + n // 16, least_common(n))


def prefix_size(n: int) -> int:
    return n - least_common(n) + guaranteed(n)


def _column(expr: str) -> str:
    """The two functions above as SQL: how many of the commonest shingles a set may skip."""
    need = f"((3 * {expr} + 3) div 4)"
    return f"(least(8 + {need} div 16, (3 * {need} + 3) div 4) - 1)"


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, n, set_id, prefix) of every document; set_id stands for the whole set."""
    rows = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text_col).alias("key"),
                       whole(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(words)
        for batch in batches:
            sizes, ids, prefixes = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingler(text)
                sizes.append(len(found))
                ids.append(None if not len(found) else
                           xxhash.xxh64_intdigest(found.tobytes(), len(found)) - (1 << 63))
                prefixes.append(found[:prefix_size(len(found))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["id", "key", "n", "set_id", "prefix"])

    return rows.mapInArrow(
        profile, f"id {kind}, key binary, n long, set_id long, prefix array<long>")


def kept_prefixes(found: DataFrame) -> DataFrame:
    """(set_id, n, kept): the rarer shingles of the prefixes that stand in several documents.

    Prefixes are the smallest hashes. Two similar sets share `guaranteed` shingles inside
    both prefixes; of these the rarest cannot be among the commonest
    guaranteed(least_common(n)) - 1 shingles of either prefix, so those are skipped. What
    a passage shared by very many documents adds to the prefixes is skipped that way, and
    a document with too few shared shingles has no partner.
    """
    shingles = found.where("n > 0").select("set_id", "n", F.explode("prefix").alias("shingle"))
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("docs")).where("docs > 1")
    listed = shingles.join(shared, "shingle").groupBy("set_id", "n").agg(
        F.sort_array(F.collect_set(F.struct("docs", "shingle"))).alias("all"))
    rare = F.slice("all", F.lit(1), F.expr(f"size(all) - {_column('n')}").cast("int"))
    return listed.where(f"size(all) > {_column('n')}").select(
        "set_id", "n", F.array_sort(F.transform(rare, lambda s: s["shingle"])).alias("kept"))


def clusters_of(kept: DataFrame) -> DataFrame:
    """(set_id, n, cluster, own): the sets that have to be compared with each other.

    Sets with equal kept prefixes and size are one group, and only groups are joined. A
    cluster belongs to a size class; groups of the class are `own`, those of the next
    class, which may be similar too, are guests. Groups that share a kept shingle are in
    one cluster; they are linked to the smallest of them, never pairwise.
    """
    size_class = F.floor(F.log("n") / math.log(CLASS_BASE)).cast("int")
    grouped = stage(kept.withColumn("gid", F.xxhash64("kept", "n")).withColumn(
        "class", size_class), "join-groups")
    sides = F.explode(F.array(F.struct(F.col("class").alias("class"), F.lit(True).alias("own")),
                              F.struct((F.col("class") - 1).alias("class"), F.lit(False).alias("own"))))

    def entered(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns, "gid", sides.alias("side")).select(
            *columns, F.xxhash64("gid", "side.class").alias("node"), "side.class", "side.own")

    groups = grouped.groupBy("gid", "class").agg(F.first("kept").alias("kept"),
                                                 F.count("*").alias("sets"))
    rows = stage(entered(groups, "kept", "sets").select(
        "node", "class", "own", "sets", F.explode("kept").alias("shingle")), "join-entries")
    least = rows.groupBy("shingle", "class").agg(
        F.min(F.when(F.col("own"), F.col("node"))).alias("first"),
        F.sum("sets").alias("members")).where("first is not null and members > 1")
    links = rows.join(least, ["shingle", "class"]).select("node", "first").distinct()
    links = stage(links, "join-links")
    roots = components(links.where("node <> first"), "node", "first", "join-clusters")
    # A group without a partner group still has to compare its own members.
    alone = links.select("node").distinct().join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("cluster"))
    return entered(grouped, "set_id", "n").join(alone, "node").select(
        "set_id", "n", "cluster", "own")


def assignments(members: DataFrame) -> DataFrame:
    """(set_id, tasks): the comparisons a set takes part in.

    A cluster beyond the size of a block is dealt into blocks, and every pair of blocks
    is one task; a set goes to the tasks of its block.
    """
    sizes = members.groupBy("cluster").agg(
        F.count("*").alias("sets"), F.sum("n").alias("shingles"),
        F.count(F.when(F.col("own"), 1)).alias("owns")).where("sets > 1 and owns > 0").select(
        F.col("cluster").alias("c"), F.greatest(
            F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_DOCS)).cast(
            "int").alias("blocks"))
    dealt = members.join(sizes, F.col("cluster") == F.col("c")).withColumn(
        "block", F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = dealt.select("set_id", "cluster", "own", "block", others.alias("other"))
    return tasks.groupBy("set_id").agg(F.collect_list(F.struct(
        F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        "own", (F.col("block") <= F.col("other")).alias("left"),
        (F.col("block") >= F.col("other")).alias("right"))).alias("tasks"))


def spanning_links(sets: list[np.ndarray], own: np.ndarray, left: np.ndarray,
                   right: np.ndarray) -> list[tuple[int, int]]:
    """Links between similar sets of one task: enough of them to connect all that are linked.

    The intersections of all left with all right sets are products of their incidence
    matrices over the shingles that at least two sets have, taken in slices of columns.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows, cols = np.nonzero(left)[0], np.nonzero(right)[0]
    every = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, which, counts = np.unique(every, return_inverse=True, return_counts=True)
    common = counts[which] > 1
    number = np.cumsum(counts > 1) - 1
    column, of = number[which[common]], of[common]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    shared = np.zeros((len(rows), len(cols)), dtype=np.float32)
    for start in range(0, int((counts > 1).sum()), 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[of[a:b], column[a:b] - start] = 1
        shared += part[rows] @ part[cols].T
    # 100 * both >= 75 * (n + m - both), in whole numbers
    similar = 7 * shared.astype(np.int64) >= 3 * (sizes[rows][:, None] + sizes[cols][None, :])
    similar &= own[rows][:, None] | own[cols][None, :]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(similar)):
        x, y = root(int(rows[i])), root(int(cols[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((int(rows[i]), int(cols[j])))
    return links


def verified_links(docs: DataFrame, found: DataFrame, tasks: DataFrame, id_col: str,
                   text_col: str, words: int) -> DataFrame:
    """Links (a, b) of set ids. Sets are made again from the texts of the documents that need it."""
    tasks = stage(tasks, "join-tasks")
    holders = found.join(tasks.select("set_id"), "set_id").groupBy("set_id").agg(
        F.min("key").alias("key"))
    wanted = stage(tasks.join(holders, "set_id").select(F.col("key").alias("k"), "set_id", "tasks"),
                   "join-wanted")
    texts = docs.select(doc_key(id_col, text_col).alias("key"), whole(text_col).alias("body"))
    if (wanted.select(F.sum(F.size("tasks"))).first()[0] or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, F.col("key") == F.col("k")).select("set_id", "tasks", "body")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            arrays = [shingler(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(arrays, pa.list_(pa.int64()))],
                ["set_id", "tasks", "shingles"])

    kind = rows.schema["tasks"].dataType.simpleString()
    dealt = rows.mapInArrow(sets, f"set_id long, tasks {kind}, shingles array<long>").select(
        "set_id", "shingles", F.explode("tasks").alias("t")).select("set_id", "shingles", "t.*")

    def compare(task: pa.Table) -> pa.Table:
        task = task.combine_chunks()
        ids, first = np.unique(task.column("set_id").to_numpy(), return_index=True)
        flags = [task.column(c).to_numpy()[first] for c in ("own", "left", "right")]
        lists = task.column("shingles")
        arrays = [lists[int(i)].values.to_numpy().view(np.uint64) for i in first]
        links = spanning_links(arrays, *flags)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()),
                         "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return dealt.groupBy("task").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5) -> DataFrame:
    """One row per document: id, key, n_shingles, component_id.

    Documents are linked when their sets of distinct shingles of `words` words have a
    Jaccard similarity of at least 0.75; component_id is the smallest id that can be
    reached by links. Equal sets are one set. Prefixes, in order of hash, are cut to
    their rarer shared shingles; sets with the same cut prefix and size are joined as one
    group; clusters of groups are expanded to their members, which are compared in
    blocks of bounded size. Every pair of sets that may be similar meets in a block, and a
    block returns a spanning forest of its links, so no group yields all its pairs.

    Sets without shingles (NULL, empty and blank texts) are linked with nothing; missing
    ids are never the smallest if the component has another. Only the two named columns
    are read.
    """
    return _placed(docs, id_col, text_col, words).select(
        F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), "component_id")


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, n, component, component_id, stays) of every document.

    `component` names its component (NULL without shingles); `stays` marks the document that
    stands for it: the smallest id, missing ids last, then the smallest key.
    """
    with transient(docs.sparkSession) as keep:
        found = stage(profiles(docs, id_col, text_col, words), "join-profiles")
        members = stage(clusters_of(kept_prefixes(found)), "join-members")
        links = verified_links(docs, found.select("set_id", "key"), assignments(members), id_col,
                               text_col, words)
        roots = stage(components(links, name="join-components"), "join-roots")
        placed = found.select("id", "key", "n", "set_id").join(
            roots, F.col("set_id") == F.col("node"), "left").select(
            "id", "key", "n", F.coalesce("root", "set_id").alias("component"))
        # Written before the join, so that a large component is split.
        least = stage(placed.where("component IS NOT NULL").groupBy("component").agg(
            F.min("id").alias("least"),
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"))
            .withColumnRenamed("component", "c"), "join-firsts")
        return keep(stage(placed.join(least, F.col("component") == F.col("c"), "left").select(
            "id", "key", "n", "component",
            F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
            (F.col("c").isNull() | (F.col("key") == F.col("first.key"))).alias("stays")),
            "join-placed"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words: int = 5) -> DataFrame:
    """One document of each component stays (its smallest id, then key), all columns.

    Of rows that repeat that document's id and text one stays, whichever Spark meets first.
    Documents without shingles all stay.
    """
    placed = _placed(docs, id_col, text_col, words).where("stays")
    key, n = free_name(docs, "_key"), free_name(docs, "_rows")
    stay = placed.groupBy(F.col("key").alias(key)).agg(
        F.count("component").alias(n))  # 0 without shingles
    rows = docs.withColumn(free_name(docs, "_of"), doc_key(id_col, text_col))
    of = rows.columns[-1]

    def kept(some: DataFrame) -> DataFrame:
        return rows.join(some.select(key), F.col(of) == F.col(key), "left_semi")

    once = kept(stay.where(F.col(n) <= 1))
    return once.union(kept(stay.where(F.col(n) > 1)).dropDuplicates([of])).drop(of)
