"""Token counts of a unigram vocabulary, without making the tokens."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"


def read_pieces(model_file: str) -> dict[str, float]:
    """The pieces that may stand in a text, with their scores, from a sentencepiece file.

    Control, unknown and byte pieces never match text and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                    or model.is_unused(i))}


class CountOnlyViterbi:
    """Number of pieces and score of the best segmentation of a text.

    An Aho-Corasick automaton names, at every end position, the pieces that end
    there. best[e] is the largest best[s] + score over pieces from s to e, and count[e]
    goes with it; no back pointers are kept and no pieces are made. Ties: of equal
    scores the piece that starts first (the longest) wins, because starts are taken in
    order and a later candidate must be strictly better. A character without a
    one-character piece may stand as unknown, at the lowest score of all less a
    penalty; it then counts as its UTF-8 bytes (byte_fallback) or as one.

    No piece crosses a character that stands in no longer piece, nor (in vocabularies
    without inner spaces) the place before a space; there the text is cut, and the parts
    add up exactly. Results of parts are remembered, `remember` of them at most. A part
    of any length needs memory only for the longest piece.
    """

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True,
                 dummy_prefix: bool = True, remember: int = 200_000):
        import ahocorasick

        pieces = {p.replace(SPACE, " "): float(s) for p, s in pieces.items() if p}
        self.byte_fallback, self.dummy_prefix, self.remember = byte_fallback, dummy_prefix, remember
        self.longest = max(map(len, pieces), default=1)
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        inside = {c for p in pieces if len(p) > 1 for c in p}
        spaced = any(" " in p.lstrip(" ") for p in pieces)
        joined = "".join(re.escape(c) for c in sorted(inside - (set() if spaced else {" "})))
        parts = [] if not joined else [f"[{joined}]+" if spaced else f" *[{joined}]+"]
        self.parts = re.compile("|".join([*parts, " +", "."]), re.DOTALL)
        self.known: dict[str, tuple[int, float]] = {}

    def __call__(self, text: str | None) -> tuple[int, float]:
        counts, scores = self.batch([text])
        return int(counts[0]), float(scores[0])

    def batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and scores of many texts: their parts are coded, each distinct one is solved once."""
        prefix = " " if self.dummy_prefix else ""
        cut = [self.parts.findall(prefix + t.replace(SPACE, " ")) if t else () for t in texts]
        coded = pa.array(itertools.chain.from_iterable(cut), pa.string()).dictionary_encode()
        solved = np.array([self.remembered(p) for p in coded.dictionary.to_pylist()],
                          float).reshape(-1, 2)
        codes = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(cut)), [len(parts) for parts in cut])
        counts, scores = (np.bincount(owner, weights=solved[codes, k], minlength=len(cut))
                          for k in (0, 1))
        return counts.astype(np.int64), scores

    def remembered(self, part: str) -> tuple[int, float]:
        found = self.known.get(part)
        if found is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            found = self.known[part] = self.best(part)
        return found

    def best(self, part: str) -> tuple[int, float]:
        """The dynamic program over one part, in a ring as long as the longest piece."""
        size = self.longest + 1
        best, count = [0.0] * size, [0] * size
        matches = self.automaton.iter(part) if len(self.automaton) else iter(())
        end, found = next(matches, (len(part), None))
        for at, char in enumerate(part):
            top, pieces = None, 0
            here = []
            while end == at:
                here.append(found)
                end, found = next(matches, (len(part), None))
            for length, score in sorted(here, reverse=True):
                start = (at + 1 - length) % size
                if top is None or best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
            if char not in self.single:
                start = at % size
                if top is None or best[start] + self.unknown > top:
                    top = best[start] + self.unknown
                    pieces = count[start] + (len(char.encode("utf-8", "replace"))
                                             if self.byte_fallback else 1)
            best[(at + 1) % size], count[(at + 1) % size] = top, pieces
        return count[len(part) % size], best[len(part) % size]


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id",
                 text_col: str = "text", byte_fallback: bool = True,
                 dummy_prefix: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, score (of the best segmentation).

    The vocabulary travels to the tasks once. There is no shuffle, and a task holds one
    Arrow batch and the remembered parts. NULL and empty texts have 0 tokens; only the
    two named columns are read; NULL and repeated ids pass through. Without byte
    fallback neighbouring unknown characters count one each.
    """
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = CountOnlyViterbi(pieces, byte_fallback, dummy_prefix)
        for batch in texts:
            counts, scores = counter.batch(batch)
            yield pd.DataFrame({"n_tokens": counts, "score": scores})

    counted = F.pandas_udf(count, "n_tokens long, score double",
                           F.PandasUDFType.SCALAR_ITER)
    return docs.select(F.col(id_col), counted(F.col(text_col)).alias("c")).select(
        id_col, "c.n_tokens", "c.score")
