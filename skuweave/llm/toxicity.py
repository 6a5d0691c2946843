"""Toxicity scores of texts whose disguises are undone first."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out, stage, whole
from .quality import labelled_sample, logistic_fit

#: Letters that a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h",
    "€": "e", "£": "l",
}
SIGNS = "".join(LEET)
EDGE = "^"  # stands before and after a word in the language model

#: Costs of the channel, as natural logarithms of probabilities.
KEEP, SWAP, SHORTEN, HALVE, JOIN = 0.0, -1.5, -0.5, -8.0, -1.0
DROP_LIKELY, DROP_UNLIKELY = -0.5, -16.0  # of separators, of signs that look like letters

TOKEN = re.compile(r"\S+")
#: Single letters (or signs for letters) with one separator between each two.
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$])(?:[ .\-_*~/](?:[^\W_]|[@$])){2,}(?![^\s.,;:?!])")
#: Signs that may stand for a letter at the start, at the end of a token.
OPENING, CLOSING = frozenset("$@!|+(<"), frozenset("$@!|+")
RUN = re.compile(r"(.)\1{2,}", re.DOTALL)


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    plain = token.strip(".,;:?\"'")
    if plain.isalpha():
        return plain.lower()
    return _stripped(token.lower())


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _stripped(token: str) -> str:
    """Without the punctuation around it; a single sign that may stand for a letter stays.

    Two of the same sign in a row are punctuation. One pass from either end.
    """
    first, last = 0, len(token)
    while first < last and not _is_word(token[first]):
        char, run = token[first], 1
        while first + run < last and token[first + run] == char:
            run += 1
        if char in OPENING and run == 1:
            break
        first += run
    while last > first and not _is_word(token[last - 1]):
        char, run = token[last - 1], 1
        while last - run > first and token[last - run - 1] == char:
            run += 1
        before = token[last - 2] if last - 2 >= first else ""
        if char in CLOSING and run == 1 and not (char == "!" and before and _is_word(before)):
            break
        last -= run
    return token[first:last]


def grams(counts: dict[str, int]) -> Counter:
    """Sequences of three letters with the edges, for words of letters only."""
    found: dict[str, int] = defaultdict(int)
    for word, n in counts.items():
        if word.isalpha():
            padded = EDGE * 2 + word + EDGE
            for i in range(len(word) + 1):
                found[padded[i:i + 3]] += n
    return found


class LetterModel:
    """Interpolated three-letter model: log P(next | the two before)."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.after = Counter(counts), Counter()
        for gram, n in counts.items():  # shorter sequences are sums of these
            self.counts[gram[1:]] += n
            self.counts[gram[2]] += n
            self.after[gram[:2]] += n
            self.after[gram[1]] += n
        self.total = sum(counts.values()) + 1
        self.known: dict[str, float] = {}

    def log_p(self, before: str, char: str) -> float:
        key = before + char
        value = self.known.get(key)
        if value is None:
            n, after = self.counts, self.after
            p = (n.get(char, 0) + 0.5) / (self.total + 200)
            p = 0.2 * p + 0.8 * n.get(before[-1] + char, 0) / max(1, after.get(before[-1], 0))
            p = 0.2 * p + 0.8 * n.get(key, 0) / max(1, after.get(before, 0))
            value = self.known[key] = math.log(max(p, 1e-9))
        return value

    def word(self, word: str) -> float:
        padded = EDGE * 2 + word + EDGE
        return sum(self.log_p(padded[i - 2:i], padded[i]) for i in range(2, len(padded)))


class Restorer:
    """Undo leetspeak, inserted signs, repeated letters and spaced letters.

    A disguised token is a lattice: a sign may be each letter it stands for or may have
    been put in between; a run of one letter may be one or two of them. Viterbi finds
    the path with the best sum of channel costs and letter model; its state is the last
    two letters. Single letters in a row become one word where the model prefers the
    word to the letters. Tokens of plain letters have one path and stay as they are, as
    do numbers. `remember` decoded tokens are kept.
    """

    def __init__(self, model: LetterModel, remember: int = 200_000):
        self.model, self.remember = model, remember
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        word = core(token)
        if word.isalpha() and not RUN.search(word):
            return word
        word = self.known.get(token)
        if word is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            word = self.known[token] = self._token(core(token))
        return word

    def _token(self, word: str) -> str:
        if word.isalpha() and not RUN.search(word):
            return word
        if any(c.isalpha() for c in word) or self.spelt(word):
            return self.decode(word)
        return word

    @staticmethod
    def spelt(word: str) -> bool:
        """Signs only, but not a number: at least one is not a digit and all stand for letters."""
        return len(word) >= 3 and all(c in LEET for c in word) and not all(
            c.isdigit() for c in word) and any(c.isdigit() or c in "@$" for c in word)

    def decode(self, word: str) -> str:
        states = {EDGE * 2: (0.0, None)}
        i = 0
        while i < len(word):
            char, run = word[i], 1
            while i + run < len(word) and word[i + run] == char:
                run += 1
            if char.isalpha():
                choices = ([(char, SHORTEN), (char * 2, SHORTEN)] if run > 2 else
                           [(char * run, KEEP), *([(char, HALVE)] if run == 2 else [])])
            else:
                choices = [(letter * k, SWAP) for letter in LEET.get(char, "")
                           for k in sorted({1, min(run, 2)})]
                choices.append(("", DROP_UNLIKELY if char in LEET else DROP_LIKELY))
            states = self._step(states, choices)
            i += run
        _, path = max(((score + self.model.log_p(last, EDGE), path)
                       for last, (score, path) in states.items()), key=lambda end: end[0])
        letters = []
        while path is not None:
            path, piece = path
            letters.append(piece)
        return "".join(reversed(letters)) or word

    def _step(self, states, choices):
        """The best path to each state; a path is (the path before, what it adds)."""
        after: dict[str, tuple[float, tuple | None]] = {}
        for last, (score, path) in states.items():
            for letters, cost in choices:
                s, ctx = score + cost, last
                for c in letters:
                    s += self.model.log_p(ctx, c)
                    ctx = ctx[1] + c
                if ctx not in after or after[ctx][0] < s:
                    after[ctx] = (s, (path, letters))
        return after

    def joined(self, text: str) -> list[str]:
        """Words that were spelt with single letters."""
        words = []
        for match in SPACED.finditer(text):
            letters = re.split(r"[ .\-_*~/]", match.group().lower())
            word = "".join(letters)
            word = word if word.isalpha() else self._token(word)
            apart = sum(self.model.word(c) for c in letters if c.isalpha())
            if self.model.word(word) + JOIN > apart:
                words.append(word)
        return words

    def text(self, text: str | None) -> str:
        """The restored words of a text, in order; words spelt apart come at the end."""
        text = text or ""
        words = [w for w in map(self.token, TOKEN.findall(text)) if w]
        return " ".join(words + self.joined(text))


def letter_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts of letter sequences over all documents.

    A task counts the words of its partition (in portions, so that memory is bounded),
    turns them into sequences and sends those; they are summed after a shuffle. The
    table is bounded by the third power of the letters in use, of which only those that
    make up at least a millionth of all text are kept.
    """
    def counted(words: Counter) -> pa.RecordBatch:
        found = grams(_cores(words))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
            ["gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(text.lower().split())
            if len(words) > 500_000:
                yield counted(words)
                words = Counter()
        yield counted(words)

    sums = docs.select(whole(text_col).alias("body")).mapInArrow(
        count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = stage(sums, "letters")
    letters = {r["c"]: r["n"] for r in sums.groupBy(F.substring("gram", 3, 1).alias("c")).agg(
        F.sum("n").alias("n")).collect()}
    least = sum(letters.values()) / 1e6
    kept = sorted(c for c, n in letters.items() if n >= least)
    if not kept:
        return {}
    inside = "^[" + "".join(re.escape(c) if c != EDGE else r"\^" for c in kept) + r"\^]+$"
    return {r["gram"]: r["n"] for r in sums.where(F.col("gram").rlike(inside)).collect()}


def _cores(words: dict[str, int]) -> Counter:
    found: Counter = Counter()
    for word, n in words.items():
        found[core(word)] += n
    return found


def features(word: str) -> tuple[str, ...]:
    """What a restored word is judged by: itself and its first four and five letters."""
    if len(word) < 3 or not word.isalpha():
        return ()
    return (f"={word}", *[f"{word[:k]}*" for k in (4, 5) if len(word) > k])


@dataclass
class ToxicityModel:
    letters: dict[str, int]
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    intercept: float = -2.0

    def judge(self):
        """A function from a text to its evidence: the weights of its distinct toxic features."""
        restorer, weights = Restorer(LetterModel(self.letters)), self.weights
        known: dict[str, tuple[str, ...]] = {}

        def of(token: str) -> tuple[str, ...]:
            hit = known.get(token)
            if hit is None:
                if len(known) >= 400_000:
                    known.clear()
                hit = known[token] = tuple(
                    f for f in features(restorer.token(token)) if f in weights)
            return hit

        def evidence(text: str | None) -> float:
            text = text or ""
            found = {f for token in TOKEN.findall(text) for f in of(token)}
            for word in restorer.joined(text):
                found.update(f for f in features(word) if f in weights)
            return math.log1p(sum(weights[f] for f in found))

        return evidence


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", label: str = "toxic", max_rows: int = 20_000,
                 max_bytes: int = 65_536, least_docs: int = 4,
                 least_weight: float = 2.0) -> ToxicityModel:
    """Letter model from all documents; weights and curve from a bounded sample of labels.

    At most `max_rows` labelled rows outside the held-out fold are used, of texts up to
    `max_bytes` (for fitting only). In half of them, features are counted per class in
    tasks and summed by a shuffle; those in at least `least_docs` toxic rows with a log
    ratio of at least `least_weight` are kept. The other half fits the curve from
    evidence to score. Without labels of both kinds the score is the share of toxic rows.
    """
    model = ToxicityModel(letter_counts(docs, text_col))
    sample = labelled_sample(docs, labels, label, max_rows, max_bytes, id_col, text_col)
    letters = model.letters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(LetterModel(letters)), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {restorer.token(t) for t in TOKEN.findall(text)} | set(restorer.joined(text))
                seen[int(y)].update({f for w in words for f in features(w)} | {""})
        found = sorted({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array([seen[1][f] for f in found], pa.int64()),
             pa.array([seen[0][f] for f in found], pa.int64())], ["f", "n1", "n0"])

    half = F.pmod("order", F.lit(2)) == 0
    counted = sample.where(half).select("body", "y").mapInArrow(
        count, "f string, n1 long, n0 long").groupBy("f").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # Rows per class; then features with enough toxic rows, bounded by the sample.
    both = counted.where("f = ''").first()
    n1, n0 = (both["n1"], both["n0"]) if both else (0, 0)
    share = (n1 + 1) / (n1 + n0 + 2)
    model.intercept = math.log(share / (1 - share))
    if not n1 or not n0:
        return model
    ratio = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    kept = counted.where("f <> ''").where(F.col("n1") >= least_docs).withColumn(
        "w", ratio).where(F.col("w") >= least_weight)
    model.weights = {r["f"]: r["w"] for r in kept.orderBy("f").collect()}
    rest = _evidence(sample.where(~half), model, "body").select("y", "evidence").collect()
    y = np.array([r["y"] for r in rest], dtype=float)
    if len(set(y)) == 2:
        w = logistic_fit(np.array([[r["evidence"]] for r in rest]), y, ridge=0.05)
        model.slope, model.intercept = float(w[0]), float(w[1])
    return model


def _evidence(rows: DataFrame, model: ToxicityModel, text_col: str,
              name: str = "evidence") -> DataFrame:
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence = model.judge()
        for batch in texts:
            yield batch.map(evidence).astype("float64")

    return rows.withColumn(name, F.pandas_udf(judge, "double", F.PandasUDFType.SCALAR_ITER)(
        whole(text_col)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                    text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, evidence, score (0 to 1), predicted.

    Every text is restored whole in the task that reads it; there is no shuffle. NULL
    and empty texts have no evidence and the score at that point. NULL ids count as held
    out; repeated rows get equal scores; other columns are not read.
    """
    power = F.greatest(F.lit(-30.0), F.least(F.lit(30.0),
                       F.col("evidence") * model.slope + model.intercept))
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("_body"))
    return (_evidence(rows, model, "_body").drop("_body")
            .withColumn("score", 1 / (1 + F.exp(-power)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, all their columns."""
    cut = math.log(threshold / (1 - threshold))
    evidence = free_name(docs, "_toxic_evidence")
    scored = _evidence(docs, model, text_col, evidence)
    return scored.where(F.col(evidence) * model.slope + model.intercept < cut).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def restored_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """id and the restored text, for review."""
    letters = model.letters

    def restore(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(LetterModel(letters))
        for batch in texts:
            yield batch.map(restorer.text)

    return docs.select(F.col(id_col), F.pandas_udf(
        restore, "string", F.PandasUDFType.SCALAR_ITER)(whole(text_col)).alias("restored"))
