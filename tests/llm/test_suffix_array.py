"""Suffix arrays and common prefixes against sorting."""

import random

import numpy as np
import pytest

from skuweave.llm.suffix_array import permuted_prefixes, suffix_array


def texts():
    rng = random.Random(4)
    for size in (1, 2, 3, 7, 30, 200, 1500):
        for letters in (1, 2, 4, 200):
            yield [rng.randint(1, letters) for _ in range(size)]
    yield [1, 2] * 300
    yield [5] * 700 + [3] + [5] * 700
    base = [rng.randint(1, 3) for _ in range(400)]
    yield base + [1] + base[:300] + [2] + base[50:]


@pytest.mark.parametrize("body", list(texts()))
def test_against_sorting(body):
    text = np.array([*body, 0], dtype=np.uint16)
    plain = [*body, 0]
    want = sorted(range(len(plain)), key=lambda i: plain[i:])
    got = suffix_array(text, int(text.max()) + 1)
    assert got.tolist() == want
    before, common = permuted_prefixes(text, got)
    for i, j in zip(want[1:], want):
        k = 0
        while i + k < len(plain) and j + k < len(plain) and plain[i + k] == plain[j + k]:
            k += 1
        assert before[i] == j and common[i] == k


def test_repeated_strings_are_found():
    rng = random.Random(5)
    body = [rng.randint(1, 2) for _ in range(3000)]
    body += body[100:900]
    text = np.array([*body, 0], dtype=np.uint16)
    before, common = permuted_prefixes(text, suffix_array(text, 3))
    found = np.zeros(len(text), dtype=bool)
    found[common >= 40] = True
    found[before[common >= 40]] = True
    strings = [tuple(body[i:i + 40]) for i in range(len(body) - 39)]
    want = [strings.count(s) > 1 for s in strings]
    assert found[:len(want)].tolist() == want
