"""Where two tokenizers agree: aligned token groups, links and their document counts.

Texts are cut into units at spaces where both tokenizers provably end a token, and the units of a
block of texts are dictionary-encoded: each distinct unit is tokenized and aligned once. The
alignment runs on flat Arrow columns: token ends are segmented cumulative sums of byte lengths,
a full outer hash join on (unit, end) lines them up, and counts come from grouped tables. Units
begin and end with the document's own token ends, so what holds for (unit, end) holds for
(document, end). Document counts of id pairs are made per block and merged by Spark.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Bytes of text whose units are encoded together; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Units that are aligned, and that documents are expanded to, in one go.
UNITS = 1 << 16

# Fixed value: how byte-level BPE cuts a text into words.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# A space after a character that is no white space ends a unit. Texts with other spaces take the
# slower way; white space is read as widely as any of the libraries does, which only means fewer cuts.
ODD_SPACE = r"^ |[\s\x0B\x1C-\x1F\x{85}\p{Z}] "
CUT = re.compile(r"(?<=\S) ")

STAGED = ("block long, kind string, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, "
          "groups_sha256 string, units array<int>, links array<array<int>>, pair int, a int, "
          "b int, docs long")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Two vocabularies over the same text: byte-level BPE (A) and pieces with a byte fallback (B).

    Both are given as the contents of their files. A's merges are in the order of its ids, so its
    words are encoded by rank.
    """

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        vocab, alphabet = json.loads(a_file), byte_alphabet()
        special = {t["content"] for t in vocab["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i
                 for token, i in vocab["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        by_id = {i: token for token, i in ranks.items()}
        self.a_bytes = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.binary())

        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("pieces of B go on behind a space: texts cannot be cut into units")
        self.b_bytes = pa.array(
            [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else
             n.replace("▁", " ").encode() for i, n in enumerate(names)], pa.binary())
        self.b_space = self.b.piece_to_id("▁")

    def encode(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Token ids of space + unit, by A and by B (which adds the space itself)."""
        a = [self.a.encode_ordinary(" " + u) for u in units]
        b = [ids if u else [self.b_space]
             for u, ids in zip(units, self.b.encode(units, num_threads=1))]
        return pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))


@functools.lru_cache(maxsize=2)
def tokenizers(a_file: bytes, b_file: bytes) -> Tokenizers:
    return Tokenizers(a_file, b_file)


# ---- Arrow columns

def ends_of(tokens: pa.ListArray, lengths: pa.Array) -> pa.Table:
    """`(unit, end)` per token, in order: byte lengths summed up within each unit."""
    unit = pc.list_parent_indices(tokens).to_numpy()
    total = pc.cumulative_sum(pc.take(lengths, pc.list_flatten(tokens)).cast(pa.int64())).to_numpy()
    before = np.concatenate([[0], total])[tokens.offsets.to_numpy()[:-1] - tokens.offsets[0].as_py()]
    return pa.table({"unit": pa.array(unit, pa.int64()), "end": total - before[unit]})


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of `values` between neighbouring offsets; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def joined(strings: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings)
    return pc.binary_join(lists, pa.scalar(by, pa.large_string()))


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def align(both: Tokenizers, units: pa.Array) -> dict:
    """`align_some` over all units, `UNITS` of them at a time, which bounds the joins' memory."""
    parts = [align_some(both, units.slice(i, UNITS))
             for i in range(0, max(len(units), 1), UNITS)]
    return {name: (pa.concat_arrays if isinstance(values, pa.Array) else np.concatenate)(
        [p[name] for p in parts]) for name, values in parts[0].items()}


def align_some(both: Tokenizers, units: pa.Array) -> dict:
    """The alignment of each unit: `ok`, `n_a`, `n_b`, `n_groups`, `groups`, and its links.

    A unit whose token bytes differ from its text is not ok and has no tokens. `links` holds one
    entry for every pair of tokens whose byte ranges overlap, in order: between two neighbouring
    ends, of whichever side, lies exactly one such pair.
    """
    a, b = both.encode(units.to_pylist())
    text = pc.binary_join_element_wise(pa.scalar(b""), units.cast(pa.binary()), b" ")
    ok = np.ones(len(units), bool)
    for tokens, names in ((a, both.a_bytes), (b, both.b_bytes)):
        spelt = pa.ListArray.from_arrays(tokens.offsets, pc.take(names, pc.list_flatten(tokens)))
        ok &= pc.equal(pc.binary_join(spelt, b""), text).to_numpy(zero_copy_only=False)
    good = pa.array(np.flatnonzero(ok))
    a, b = pc.take(a, good), pc.take(b, good)
    a_ids, b_ids = pc.list_flatten(a), pc.list_flatten(b)
    a_ends = ends_of(a, pc.binary_length(both.a_bytes)).append_column(
        "in_a", pa.array(np.ones(len(a_ids), np.int8)))
    b_ends = ends_of(b, pc.binary_length(both.b_bytes)).append_column(
        "in_b", pa.array(np.ones(len(b_ids), np.int8)))
    met = a_ends.join(b_ends, ["unit", "end"], join_type="full outer", use_threads=False)
    unit = met["unit"].to_numpy()
    order = np.argsort((unit << 32) + met["end"].to_numpy())
    unit = unit[order]
    in_a = pc.fill_null(met["in_a"], 0).to_numpy()[order]
    in_b = pc.fill_null(met["in_b"], 0).to_numpy()[order]

    # A token that has not ended before this end is the one that covers it.
    a_done, b_done = np.cumsum(in_a, dtype=np.int64), np.cumsum(in_b, dtype=np.int64)
    link_a = a_ids.to_numpy()[a_done - in_a].astype(np.int64) if len(unit) else unit
    link_b = b_ids.to_numpy()[b_done - in_b].astype(np.int64) if len(unit) else unit
    shared = (in_a & in_b).astype(bool)

    def spelt_ids(ids: pa.Array, done: np.ndarray) -> pa.Array:
        return joined(ids.cast(pa.large_string()), np.concatenate([[0], done[shared]]), ",")

    def per_unit(counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units), np.int64)
        out[ok] = counts
        return out

    many = int(ok.sum())
    n_groups = per_unit(np.bincount(unit[shared], minlength=many))
    groups = pc.binary_join_element_wise(spelt_ids(a_ids, a_done), spelt_ids(b_ids, b_done),
                                          pa.scalar("|", pa.large_string()))
    return {"ok": ok, "n_a": per_unit(pc.list_value_length(a).to_numpy()),
            "n_b": per_unit(pc.list_value_length(b).to_numpy()), "n_groups": n_groups,
            "groups": joined(groups, offsets_of(n_groups), ";"),
            "n_links": per_unit(np.bincount(unit, minlength=many)),
            "links": (link_a << 32) + link_b}


def units_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Offsets per text, and the units of all texts, dictionary-encoded. Empty texts have none."""
    odd = pc.or_(pc.match_substring_regex(texts, ODD_SPACE), pc.equal(texts, ""))
    cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    if pc.any(odd).as_py():
        whole = cut.to_pylist()
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            text = texts[int(i)].as_py()
            whole[i] = CUT.split(text) if text else []
        cut = pa.array(whole, pa.list_(pa.string()))
    flat = pc.list_flatten(cut)
    return offsets_of(pc.list_value_length(cut).to_numpy()), flat.dictionary_encode()


def block_rows(both: Tokenizers, ids: pa.Array, texts: pa.Array, block: int,
               schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The staged rows of one block: its documents, its units' links, and its pairs."""
    offsets, coded = units_of(pc.fill_null(texts, ""))
    codes, found = coded.indices.to_numpy(), align(both, coded.dictionary)
    sizes = offsets[1:] - offsets[:-1]
    ok = sums(~found["ok"][codes], offsets) == 0

    def rows(kind: str, n: int, **columns) -> pa.RecordBatch:
        full = {"block": np.full(n, block), "kind": [kind] * n, **columns}
        return pa.RecordBatch.from_arrays(
            [pa.array(full[f.name], f.type) if f.name in full else pa.nulls(n, f.type)
             for f in schema], schema=schema)

    def total(name: str) -> np.ndarray:
        return np.where(ok, sums(found[name][codes], offsets), 0)

    digests = []
    for first, last in slices(offsets):
        some = offsets[first:last + 1]
        spelt = joined(pc.take(found["groups"], pa.array(codes[some[0]:some[-1]])),
                       some - some[0], ";")
        digests += [hashlib.sha256(text.as_buffer()).hexdigest() if ok[i] and sizes[i] else ""
                    for i, text in enumerate(spelt, first)]
    kept = np.repeat(ok, sizes)
    units = pa.ListArray.from_arrays(
        pa.array(offsets_of(np.where(ok, sizes, 0)), pa.int32()), pa.array(codes[kept], pa.int32()))
    pairs = pa.array(found["links"]).dictionary_encode()
    per_unit = pa.ListArray.from_arrays(pa.array(offsets_of(found["n_links"]), pa.int32()),
                                        pairs.indices.cast(pa.int32()))
    yield rows("doc", len(ids), doc_id=ids, n_a=total("n_a"), n_b=total("n_b"),
               n_groups=total("n_groups"), n_links=total("n_links"), groups_sha256=digests,
               units=units)
    yield rows("units", 1, links=pa.ListArray.from_arrays(
        pa.array([0, len(per_unit)], pa.int32()), per_unit))

    # In how many documents a pair stands: distinct (document, unit), then distinct (document, pair).
    many, many_pairs = max(len(coded.dictionary), 1), max(len(pairs.dictionary), 1)
    docs = np.zeros(many_pairs, np.int64)
    for first, last in slices(offsets):
        at = slice(offsets[first], offsets[last])
        owner = np.repeat(np.arange(last - first), sizes[first:last])
        held = _distinct((owner * many + codes[at])[kept[at]])
        lists = pc.take(per_unit, pa.array(held % many))
        seen = (held // many)[pc.list_parent_indices(lists).to_numpy()]
        seen = _distinct(seen * many_pairs + pc.list_flatten(lists).to_numpy())
        docs += np.bincount(seen % many_pairs, minlength=many_pairs)
    counted = np.flatnonzero(docs)
    names = pairs.dictionary.to_numpy()[counted]
    yield rows("pair", len(names), pair=counted, a=names >> 32, b=names & 0xFFFFFFFF,
               docs=docs[counted])


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with `UNITS` units or fewer between them; a longer text stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + UNITS, "right")) - 1, first + 1)
        yield first, min(last, len(offsets) - 1)
        first = last


def _distinct(keys: np.ndarray) -> np.ndarray:
    return pa.table({"k": keys}).group_by("k", use_threads=False).aggregate([])["k"].to_numpy()


def blocks_of(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows `(doc_id, text)` in blocks of about `size` bytes of text."""
    held, held_bytes = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(lengths.tolist()):
            if held_bytes and held_bytes + n > size:
                held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, held_bytes, at = [], 0, i
            held_bytes += n
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _aligner(a_file: bytes, b_file: bytes, size: int,
             schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        both = tokenizers(a_file, b_file)
        for n, rows in enumerate(blocks_of(batches, size)):
            if rows.num_rows:
                block = (TaskContext.get().partitionId() << 32) + n
                yield from block_rows(both, rows["doc_id"].combine_chunks(),
                                      rows["text"].combine_chunks(), block, schema)
                pa.default_memory_pool().release_unused()
    return run


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with the corpus-wide counts of their links summed up."""
    docs = left.filter(pc.equal(left["kind"], "doc"))
    links = left.filter(pc.equal(left["kind"], "units"))["links"].combine_chunks()[0].values
    offsets, flat, at = links.offsets.to_numpy(), links.values.to_numpy(), right["pair"].to_numpy()
    # Pairs that stand only in documents without tokens were counted nowhere.
    many = max(int(flat.max(initial=-1)), int(at.max(initial=-1))) + 1
    count, best = np.zeros(many, np.int64), np.zeros(many, np.int64)
    count[at] = right["count"].to_numpy()
    best[at] = right["best"].to_numpy()
    of_unit = {"count_sum": sums(count[flat], offsets),
               "n_best": sums(best[flat], offsets)}
    units = docs["units"].combine_chunks()
    ends = units.offsets.to_numpy() - units.offsets[0].as_py()
    codes = pc.list_flatten(units).to_numpy()
    for name, values in of_unit.items():
        docs = docs.append_column(name, pa.array(sums(values[codes], ends)))
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256"])


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                   text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokenize and align every text; the staged rows of kinds `doc`, `units` and `pair`.

    A document's `units` are numbers into the links of its block, a link is a number of a pair of
    its block, and `pair` rows say which ids those are and in how many documents of the block they
    stand. The vocabulary files are read by the driver and go to the tasks with the function.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = STAGED.format(id=rows.schema["doc_id"].dataType.simpleString())
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        a_file, b_file = a.read(), b.read()
    empty = docs.sparkSession.createDataFrame([], schema)
    fn = _aligner(a_file, b_file, block_bytes, to_arrow_schema(empty.schema))
    return stage(rows.mapInArrow(fn, empty.schema), "align-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """`(a, b, count)`: in how many documents of the corpus an A id and a B id are linked."""
    return blocks.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("docs").alias("count"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                     text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: tokens of both sides, groups, links, and what the corpus says of the links.

    `(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`. NULL and empty
    texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens:
    zeros and an empty digest. Rows are documents: repeated ids and texts count each, a NULL id is
    kept. Extra columns are ignored. An empty table gives no rows.

    Counts are summed per block before they are shuffled, so a pair that every document holds has
    one row per block. The best count per A id has at most as many rows as A has ids, and that
    table alone is broadcast. Documents do not move for the counts: their block's units do, once,
    to meet the counts of the block's pairs.
    """
    blocks = aligned_blocks(docs, a_path, b_path, id_col, text_col, block_bytes)
    counts = stage(pair_counts(blocks), "align-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = (blocks.where("kind = 'pair'").select("block", "pair", "a", "b")
              .join(counts, ["a", "b"]).join(F.broadcast(most), "a")
              .select(F.col("block").alias("of_block"), "pair", "count", (F.col("count") == F.col("most")).cast("int")
                      .alias("best")))
    held = blocks.where("kind <> 'pair'").drop("pair", "a", "b", "docs")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    return held.groupBy("block").cogroup(judged.groupBy("of_block")).applyInArrow(
        _scored, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                 "count_sum long, groups_sha256 string")
