import hashlib
from collections import Counter

import pytest

from conftest import SMALL
from skuweave.llm import token_alignment as ta
from skuweave.llm.queries import BYTE_VOCABULARY, PIECES


@pytest.fixture(scope="module")
def brute():
    """Whole texts through the two libraries, tokens compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = ta.byte_alphabet()

    def tokens(text):
        one = [(i, bytes(alphabet[c] for c in a.id_to_token(i)))
               for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        same = {b"".join(x for _, x in one), b"".join(x for _, x in two), (" " + text).encode()}
        return (one, two) if len(same) == 1 else ([], [])

    def ranges(side):
        out, at = [], 0
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def run(rows):
        found, counts = [], Counter()
        for doc_id, text in rows:
            one, two = map(ranges, tokens(text) if text else ([], []))
            links = [(x, y) for x, p, q in one for y, r, s in two if p < s and r < q] if len(
                one) < 3000 else None
            ends = sorted({q for *_, q in one} & {s for *_, s in two})
            groups, last = [], 0
            for end in ends:
                groups.append(",".join(str(x) for x, p, q in one if last < q <= end) + "|" + ",".join(
                    str(y) for y, r, s in two if last < s <= end))
                last = end
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            found.append((doc_id, len(one), len(two), len(groups), links, digest))
            counts.update(set(links))
        best = {}
        for (x, _), n in counts.items():
            best[x] = max(best.get(x, 0), n)
        return sorted(((d, n, m, g, len(k), sum(counts[p] == best[p[0]] for p in k),
                        sum(counts[p] for p in k), h) for d, n, m, g, k, h in found), key=str)
    return run


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a  b", "tab\t x", "line\n\n  two \n", "x\u0085 y",
       "▁", "a ▁b", "café naïve", "é ́", "日本語 の テキスト", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467",
       "<|endoftext|> </s> <s> <unk> <0x41>", "it's we'll 'd", "a\x00b c", "\x1c x", "  lead", "1234 5678 9",
       "　   z", "same words same words", "same words same words", "﻿bom �", "A" * 500, "zz yy xx ww vv uu ▁"]


def test_odd_texts_against_whole_texts(spark, brute):
    rows = list(enumerate(ODD)) + [(None, "same words"), (3, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS block", "2 AS kind", "3 AS units").repartition(3)
    for size in (1, 1 << 20):
        got = ta.align_tokenizers(docs, BYTE_VOCABULARY, PIECES, block_bytes=size).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_documents_against_whole_texts(spark, brute):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()
            if len(r.text) < 4000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = ta.align_tokenizers(docs, BYTE_VOCABULARY, PIECES, block_bytes=50_000).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert ta.align_tokenizers(docs, BYTE_VOCABULARY, PIECES).collect() == []


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 300_000), (2, " " * 300_000), (3, "word " * 100_000),
                                  (4, "\n" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in ta.align_tokenizers(docs, BYTE_VOCABULARY, PIECES).collect()}
    assert got[3].n_a == 100_001 and all(r.n_links >= max(r.n_a, r.n_b) for r in got.values())
