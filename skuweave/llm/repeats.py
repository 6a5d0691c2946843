"""Removal of passages that stand elsewhere in the corpus, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, stage, transient, whole
from .suffix_array import permuted_prefixes, suffix_array

#: Bytes that one suffix array is made of, about; an anchor beyond it is taken apart.
SHARD_BYTES = 1 << 20

#: Segments and removed spans are broadcast up to this number; beyond, they are joined.
BROADCAST_ROWS = 1_500_000

#: Bytes hashed at once; longer texts are read in overlapping pieces. A task holds some 100 times as much.
PIECE = 1 << 18


def _odd_powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


#: A number for each byte, and another.
_NUMBERS = np.frombuffer(b"".join(hashlib.blake2b(bytes([i])).digest() for i in range(256)),
                         dtype=np.uint64).reshape(256, 8)
BYTE_NUMBERS = _NUMBERS[:, 1].copy()


def _running(values: np.ndarray) -> np.ndarray:
    """Running sums modulo 2 to the 64, with 0 in front (a plain 0 would make them floats)."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


class Anchors:
    """Cut the windows of a text by anchors that depend on their content alone.

    The anchor of a window of `length` bytes is the place in it where the hash of `gram`
    bytes is least (the first such place). Equal windows have equal anchors at the same
    place, wherever they stand. Neighbouring windows with one anchor are a segment: a run
    of window starts. For each segment: first start, anchor hash, hash of its bytes.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, length: int):
        self.length, self.gram = length, max(1, length // 4)
        self.for_gram, self.for_bytes = _NUMBERS[:, 0].copy(), BYTE_NUMBERS
        size = 2 * PIECE + length + 1
        self.powers = _odd_powers(self.BASE, size)
        self.inverse = _odd_powers(pow(self.BASE, -1, 1 << 64), size)

    def gram_hashes(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of all runs of `gram` bytes, by doubling."""
        made, width, result, have = self.for_gram[raw], 1, None, 0
        with np.errstate(over="ignore"):
            while True:
                if self.gram & width:
                    if result is None:
                        result, have = made, width
                    else:
                        count = min(len(made), len(result) - width) if len(result) > width else 0
                        result = made[:count] * np.uint64(pow(self.BASE, have, 1 << 64)) + \
                            result[width:width + count]
                        have += width
                if have == self.gram:
                    break
                made = made[:-width] * np.uint64(pow(self.BASE, width, 1 << 64)) + made[width:] \
                    if len(made) > width else made[:0]
                width *= 2
            result = result ^ (result >> np.uint64(31))
            result = result * np.uint64(0xD6E8FEB86659FD93)
        return result ^ (result >> np.uint64(32))

    def first_least(self, values: np.ndarray) -> np.ndarray:
        """For each window, the place of the first least value among its gram places."""
        width = self.length - self.gram + 1
        least = (values >> np.uint64(32)).astype(np.uint32)
        place = np.arange(len(values), dtype=np.int32)
        step = 1
        while 2 * step <= width:
            better = least[step:] < least[:-step]
            place = np.where(better, place[step:], place[:-step])
            least = np.where(better, least[step:], least[:-step])
            step *= 2
        rest = width - step
        if rest:
            better = least[rest:] < least[:-rest]
            place = np.where(better, place[rest:], place[:-rest])
        return place

    def segments(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """(piece, first start, anchor hash, byte hash) of all segments of the pieces."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - self.length + 1, 0)
        if not counts.sum():
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty
        of = np.repeat(np.arange(len(pieces)), counts)
        start = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(begins, counts) + start
        hashes = self.gram_hashes(raw)
        anchor = self.first_least(hashes)[place]
        first = np.flatnonzero(np.concatenate(
            [[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
        last = np.append(first[1:], len(of)) - 1
        with np.errstate(over="ignore"):
            sums = _running(self.for_bytes[raw] * self.powers[:len(raw)])
            a, b = place[first], place[last] + self.length
            content = (sums[b] - sums[a]) * self.inverse[a]
            content ^= (b - a).astype(np.uint64) * np.uint64(self.BASE)
        return of[first], start[first], hashes[anchor[first]].view(np.int64), content.view(np.int64)


def anchor_rows(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(key, id, n, first, anchor, content) of every document; the last three are arrays."""
    rows = docs.select(doc_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"),
                       whole(text_col).cast("binary").alias("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)

        def flush(at: list[int], of: list[int], shift: list[int], pieces: list[bytes],
                  batch: pa.RecordBatch) -> pa.RecordBatch:
            piece, first, anchor, content = anchors.segments(pieces)
            first = first + np.array(shift, dtype=np.int64)[piece]
            counts = np.bincount(np.array(of, dtype=np.int64)[piece] - at[0], minlength=len(at))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            part = batch.slice(at[0], len(at))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64()))
                     for x in (first, anchor, content)]
            size = pa.array([len(v.as_buffer()) for v in part.column(2)], pa.int64())
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), size, *lists],
                ["key", "id", "n", "first", "anchor", "content"])

        for batch in batches:
            at, of, shift, pieces, held = [], [], [], [], 0
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                if held + len(raw) > PIECE and at:
                    yield flush(at, of, shift, pieces, batch)
                    at, of, shift, pieces, held = [], [], [], [], 0
                at.append(i)
                if len(raw) <= PIECE:
                    of.append(i)
                    shift.append(0)
                    pieces.append(raw)
                    held += len(raw)
                else:
                    yield long_row(anchors, raw, batch, i)
                    at.pop()
                    if at:
                        yield flush(at, of, shift, pieces, batch)
                        at, of, shift, pieces, held = [], [], [], [], 0
            if at:
                yield flush(at, of, shift, pieces, batch)

    def long_row(anchors: Anchors, raw: bytes, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        """A text beyond PIECE: its windows are cut piece by piece."""
        parts = []
        for begin in range(0, max(1, len(raw) - length + 1), PIECE):
            _, first, anchor, content = anchors.segments([raw[begin:begin + PIECE + length - 1]])
            parts.append((first + begin, anchor, content))
        lists = [pa.array([np.concatenate(x)], pa.list_(pa.int64())) for x in zip(*parts)]
        part = batch.slice(i, 1)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array([len(raw)], pa.int64()), *lists],
            ["key", "id", "n", "first", "anchor", "content"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"key binary, id {kind}, n long, first array<long>, "
                                "anchor array<long>, content array<long>")


def marked_ranges(bodies: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(body, first, last): runs of window starts whose hash stands at another place too.

    Equal windows have equal hashes, so no repeated window is left out; what two windows with one
    hash have in common is for the suffix array to say. Hashes of all windows come from running
    sums. Most of them are alone in a table of counts by their upper bits, and only the others
    are sorted.
    """
    raw = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    starts = int(counts.sum())
    if not starts:
        return []
    with np.errstate(over="ignore"):
        powers = _odd_powers(Anchors.BASE, len(raw) + 1)
        sums = _running(BYTE_NUMBERS[raw] * powers[:-1])
        at = np.arange(starts) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
        inverse = _odd_powers(pow(Anchors.BASE, -1, 1 << 64), len(raw) + 1)
        hashes = (sums[at + length] - sums[at]) * inverse[at]
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    bits = max(8, min(26, int(starts).bit_length() + 2))
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)
    order = maybe[np.argsort(hashes[maybe], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    marked = np.zeros(starts, bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    places = np.flatnonzero(marked)
    if not len(places):
        return []
    owner = np.repeat(np.arange(len(bodies)), counts)[places]
    new = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(owner) > 0)])
    first, last = places[new], np.append(places[np.flatnonzero(new)[1:] - 1], places[-1])
    of, shift = owner[new], (np.cumsum(counts) - counts)[owner[new]]
    return list(zip(of.tolist(), (first - shift).tolist(), (last - shift).tolist()))


def repeated_starts(bodies: list[bytes], copies: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For the segments of one shard, the runs of starts whose window stands elsewhere too.

    A segment with several copies repeats as a whole. Of the others, ranges of windows that may
    repeat are taken out; equal ranges are one, with its number, and the different ones go to
    the suffix array.
    """
    runs = [[(0, len(b) - length)] if n > 1 else [] for b, n in zip(bodies, copies)]
    held: dict[bytes, list[tuple[int, int]]] = {}
    for of, first, last in marked_ranges(bodies, length):
        held.setdefault(bodies[of][first:last + length], []).append((of, first))
    if held:
        number = np.array([len(places) for places in held.values()])
        for places, found in zip(held.values(), suffix_runs(list(held), number, length)):
            for of, first in places:
                if copies[of] <= 1:
                    runs[of] += [(first + a, first + b) for a, b in found]
    return [sorted(r) for r in runs]


def suffix_runs(bodies: list[bytes], copies: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Runs of window starts in each body whose window stands in another place of the bodies.

    The bodies are joined with a separator; a window inside one repeats if its suffix has
    `length` symbols in common with a neighbour in the suffix array, or if its body has
    several copies.
    """
    runs = [[(0, len(b) - length)] if n > 1 else [] for b, n in zip(bodies, copies)]
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", dtype=np.uint8)
    text = raw.astype(np.uint16) + 2
    ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
    text[ends] = 1
    text[-1] = 0
    before, common = permuted_prefixes(text, suffix_array(text, 258))
    found = np.zeros(len(text) + 1, dtype=bool)
    # What crosses a separator is no window.
    inside = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(text)) >= length
    same = (common >= length) & inside
    found[:-1][same] = True
    found[before[same]] = True
    begins = ends - np.array([len(b) for b in bodies])
    edges = np.flatnonzero(found[1:] != found[:-1]) + 1
    if found[0]:
        edges = np.concatenate([[0], edges])
    a, b = edges[::2], edges[1::2] - 1
    owner = np.searchsorted(begins, a, side="right") - 1
    for i, x, y in zip(owner, a, b):
        if copies[i] <= 1:
            runs[i].append((int(x - begins[i]), int(y - begins[i])))
    return runs


RUNS = "array<struct<a:long,b:long>>"
_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _as_runs(runs: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], _RUNS)


def _limited(df: DataFrame, rows: DataFrame) -> DataFrame:
    """A broadcast of `df` if it has few enough rows, counted in `rows`."""
    return F.broadcast(df) if rows.count() <= BROADCAST_ROWS else df


def repeated_segments(docs: DataFrame, found: DataFrame, segments: DataFrame, id_col: str,
                      text_col: str, length: int) -> DataFrame:
    """(anchor, content, runs) of the segments in which windows repeat.

    One copy of each different segment is read from a document that has it and goes to
    the shard of its anchor; equal windows have one anchor and so meet in one suffix
    array. The number of shards grows with the bytes. An anchor with more bytes than a
    shard is taken apart instead: all its windows are counted by 128-bit hashes, which
    combines before its shuffle and needs no group in one place.
    """
    size = F.col("last") - F.col("first") + length
    loads = segments.groupBy("anchor").agg(F.sum(size).alias("bytes"))
    total = loads.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = stage(loads.where(F.col("bytes") > SHARD_BYTES).select("anchor"), "repeat-hot")
    texts = docs.select(doc_key(id_col, text_col).alias("key"), whole(text_col).cast("binary").alias("raw"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes()
                parts = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_pydict({
                    **{c: [p[c] for p in parts] for c in ("anchor", "content", "copies")},
                    "body": [raw[p["first"]:p["last"] + length] for p in parts]},
                    schema=pa.schema([("anchor", pa.int64()), ("content", pa.int64()),
                                      ("copies", pa.int64()), ("body", pa.binary())]))

    def cut(part: DataFrame) -> DataFrame:
        """The bytes of segments, read from the documents that hold them."""
        wanted = stage(part.groupBy("rid").agg(F.collect_list(F.struct(
            "anchor", "content", "copies", "first", "last")).alias("parts")).join(
            found.select("rid", "key"), "rid").select(F.col("key").alias("k"), "parts"), "repeat-wanted")
        return texts.join(_limited(wanted, part), F.col("key") == F.col("k")).select(
            "parts", "raw").mapInArrow(bodies, "anchor long, content long, copies long, body binary")

    shard = F.pmod(F.xxhash64("anchor", F.lit("shard")), F.lit(shards)).alias("shard")

    def search(part: pa.Table) -> pa.Table:
        ids = list(zip(part.column("anchor").to_pylist(), part.column("content").to_pylist()))
        one = {x: i for i, x in enumerate(ids)}  # rows that repeat id and text bring it twice
        chosen = sorted(one.values())
        texts_, copies = part.column("body").to_pylist(), part.column("copies").to_pylist()
        runs = repeated_starts([texts_[i] for i in chosen],
                               np.array([copies[i] for i in chosen]), length)
        kept = [k for k, r in enumerate(runs) if r]
        return pa.table({"anchor": pa.array([ids[chosen[k]][0] for k in kept], pa.int64()),
                         "content": pa.array([ids[chosen[k]][1] for k in kept], pa.int64()),
                         "runs": _as_runs([runs[k] for k in kept])})

    result = cut(segments.join(hot, "anchor", "left_anti")).select(shard, "anchor", "content", "copies", "body").groupBy(
        "shard").applyInArrow(search, f"anchor long, content long, runs {RUNS}")
    if hot.isEmpty():
        return result

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = row["body"]
                digests = [hashlib.blake2b(body[i:i + length], digest_size=16).digest()
                           for i in range(len(body) - length + 1)]
                yield pa.RecordBatch.from_pydict(
                    {"anchor": [row["anchor"]] * len(digests),
                     "content": [row["content"]] * len(digests),
                     "copies": [row["copies"]] * len(digests), "at": list(range(len(digests))),
                     "window": digests},
                    schema=pa.schema([("anchor", pa.int64()), ("content", pa.int64()),
                                      ("copies", pa.int64()), ("at", pa.int64()),
                                      ("window", pa.binary())]))

    every = stage(cut(segments.join(hot, "anchor", "left_semi")).dropDuplicates(
        ["anchor", "content"]).mapInArrow(
        windows, "anchor long, content long, copies long, at long, window binary"), "repeat-windows")
    often = every.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    single = every.join(often, "window", "left_semi").groupBy("anchor", "content").agg(
        F.transform(F.sort_array(F.collect_set("at")), lambda x: F.struct(
            x.alias("a"), x.alias("b"))).alias("runs"))
    return result.union(single)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 200) -> DataFrame:
    """(key, spans): window starts, as runs (a, b), that stand somewhere else too; key as in doc_key."""
    found = stage(anchor_rows(docs, id_col, text_col, length).select(
        F.monotonically_increasing_id().alias("rid"), "*"), "repeat-anchors")
    listed = found.where("size(first) > 0").select("rid", "n", "first", F.posexplode(
        F.arrays_zip("anchor", "content")).alias("i", "s")).select(
        "rid", F.col("s.anchor").alias("anchor"), F.col("s.content").alias("content"),
        F.get("first", F.col("i")).alias("first"),
        (F.coalesce(F.get("first", F.col("i") + 1), F.col("n") - length + 1) - 1).alias("last"))
    anchors = found.select(F.explode(F.arrays_zip("anchor", "content")).alias("s")).groupBy(
        F.col("s.anchor").alias("anchor")).agg(
        F.count("*").alias("places"), F.min("s.content").alias("least"), F.max("s.content").alias("most"))
    # Written, so that the join below has a shuffle of its own that AQE can split at a hot anchor.
    twice = stage(anchors.where("places > 1").select(
        "anchor", (F.col("least") == F.col("most")).alias("alike")), "repeat-twice")
    places = stage(listed.join(twice, "anchor"), "repeat-places")
    # All segments of the anchor are equal: each window of them stands in all its places.
    whole_segments = places.where("alike").select("rid", F.struct(
        F.col("first").alias("a"), F.col("last").alias("b")).alias("s"))
    places = places.where("not alike")
    # The place that is read for a segment is fixed by the smallest row; first and last go with it.
    holders = places.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct(
            "rid", "first", (F.col("last") - F.col("first")).alias("extent"))).alias("h"))
    segments = stage(holders.select(
        "anchor", "content", "h.rid", "copies", "h.first",
        (F.col("h.first") + F.col("h.extent")).alias("last")), "repeat-segments")
    runs = stage(repeated_segments(docs, found, segments, id_col, text_col, length), "repeat-runs")
    spans = places.join(runs, ["anchor", "content"]).select("rid", F.explode(F.transform(
        "runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"),
                                   (F.col("first") + r["b"]).alias("b")))).alias("s"))
    return spans.union(whole_segments).groupBy("rid").agg(
        F.sort_array(F.collect_list("s")).alias("spans")).join(
        found.select("rid", "key"), "rid").select("key", "spans").dropDuplicates(["key"])


def _joined(spans: str, length: int) -> Column:
    """Sorted, disjoint runs of window starts whose windows touch, as one run each."""
    last = F.size(spans) - 1
    begins = F.filter(spans, lambda s, i: (i == 0) | (
        s["a"] > F.get(F.col(spans), i - 1)["b"] + length))
    ends = F.filter(spans, lambda s, i: (i == last) | (
        F.get(F.col(spans), i + 1)["a"] > s["b"] + length))
    return F.zip_with(begins, ends, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length: int = 200) -> DataFrame:
    """One row per document: id, n_bytes, removed (runs of bytes: from, to), kept (bytes).

    A byte goes when a string of `length` bytes that covers it also starts at another
    place, in the same or another document. Places are judged on the input, so all copies
    of a passage go. Texts are bytes of UTF-8; no string crosses documents.

    Windows are cut into segments at anchors. Anchors that occur once cannot be in a
    repeated window; where all segments of an anchor are equal, all their windows are. The
    others' segments are collapsed to different ones, with their number of copies, and
    searched by suffix arrays of shards of bounded size. Documents
    meet only by anchors, never as a group; a passage in very many documents is one segment
    inside, and what differs around it is spread over shards.

    NULL counts as empty. Rows that repeat id and text each count as a place, so their
    texts of at least `length` bytes go. Only the two named columns are read.
    """
    with transient(docs.sparkSession) as keep:
        spans = keep(stage(repeated_spans(docs, id_col, text_col, length), "repeat-spans"))
    spans = spans.select("key", _joined("spans", length).alias("spans"))
    pieces = spans.select(F.explode("spans"))
    rows = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text_col).alias("key"),
                       whole(text_col).cast("binary").alias("raw"))
    rows = rows.join(_limited(spans.withColumnRenamed("key", "k"), pieces),
                     F.col("key") == F.col("k"), "left").select("id", "raw", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone: list[list[int]] = []
                for s in spans or ():
                    a, b = s["a"], s["b"] + length
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                edges = [0, *[x for g in gone for x in g], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"a": a, "b": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64()),
                 pa.array(removed, _RUNS), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "removed", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        remove, f"id {kind}, n_bytes long, removed {RUNS}, kept binary").withColumnRenamed("id", id_col)
