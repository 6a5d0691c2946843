"""Count-only Viterbi against the tokenizers library and against all segmentations."""

import random
from itertools import combinations

import pytest

from skuweave.llm import queries
from skuweave.llm.token_counts import CountOnlyViterbi, read_pieces, token_counts

PIECES = {"▁": -3.0, "a": -1.0, "b": -2.0, "ab": -3.0, "ba": -2.5, "▁a": -2.0,
          "▁ab": -4.0, "abab": -6.0, "c": -5.0, "▁▁": -1.0}


def library(pieces, byte_fallback=True):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", min(pieces.values()))] + [(f"<0x{i:02X}>", min(pieces.values()))
                                                  for i in range(256)]
    own = {p: s for p, s in pieces.items()}
    return Tokenizer(models.Unigram(vocab + list(own.items()), 0, byte_fallback))


def marked(text):
    """Spaces and the word start as the vocabulary writes them."""
    return "▁" + text.replace(" ", "▁")


def brute(pieces, text, unknown):
    """Best score over all ways to cut, unknown characters as their bytes."""
    text = marked(text)
    best = None
    for k in range(len(text)):
        for cut in combinations(range(1, len(text)), k):
            parts = [text[i:j] for i, j in zip((0, *cut), (*cut, len(text)))]
            if all(p in pieces or (len(p) == 1) for p in parts):
                score = sum(pieces.get(p, unknown) for p in parts)
                best = score if best is None else max(best, score)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_small_vocabulary_against_all_segmentations(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("aabbc d") for _ in range(rng.randint(1, 9)))
    counter = CountOnlyViterbi(PIECES)
    assert counter(text)[1] == pytest.approx(brute(PIECES, text, -16.0))
    assert counter(text)[0] == len(library(PIECES).encode(marked(text)).ids)


def test_public_vocabulary_against_the_library(spark):
    pieces = read_pieces(queries.PIECES)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
             .select("text").limit(60).collect()]
    texts += ["", " ", "   x", "a  b\n\nc", "你好 \U0001f600", "▁x", "zz" * 500, "İ́"]
    counter, other = CountOnlyViterbi(pieces, remember=50), library(pieces)
    for text in texts:
        if "<" not in text:
            want = len(other.encode(marked(text)).ids) if text else 0
            assert counter(text)[0] == want, text[:80]


def test_defined_cases(spark):
    rows = [(1, None, "q"), (2, "", "q"), (None, "ab ab", "q"), (4, "ab ab", None), (4, "ab ab", "q"),
            (5, "x" * 100_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(token_counts(docs, PIECES).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [r.n_tokens for r in got] == [2, 0, 0, 2, 2, 100_001]
    assert token_counts(docs.limit(0), PIECES).count() == 0
    assert CountOnlyViterbi({}, byte_fallback=False)("abc") == (4, -40.0)
