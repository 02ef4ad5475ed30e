"""Sampled segmentations: lossless, reproducible, and distributed as the lattice says."""

import math
from array import array
from collections import Counter

import pytest

from breathline.llm.pieces import MARK, Sampler

SAMPLER = Sampler()


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "hello world\n\tx", f"a{MARK}b {MARK}", "ñandú 梦 \U0001f600", "x" * 3000])
def test_round_trip(text):
    for key in "abc":
        ids = SAMPLER.encode(text, key)
        assert SAMPLER.decode(ids) == text
        assert ids == SAMPLER.encode(text, key)


def test_shares_follow_the_weights():
    text = MARK + "the"
    paths = Counter()
    def walk(at, ids, weight):
        if at == len(text):
            paths[tuple(ids)] = math.exp(weight)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in SAMPLER.id:
                walk(end, [*ids, SAMPLER.id[text[at:end]]], weight + SAMPLER.weight[text[at:end]])
    walk(0, [], 0.0)
    n, total = 20_000, sum(paths.values())
    drawn = Counter(tuple(SAMPLER.encode("the", str(k))) for k in range(n))
    assert set(drawn) <= set(paths)
    for path, share in paths.items():
        p = share / total
        assert abs(drawn[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_table_is_small_and_draws_are_those_of_the_edges():
    own = Sampler()
    texts = [f"unit{n} of number {n * n} in text {n}é" for n in range(300)]
    ids, offsets = own.encode_many(texts, [str(n) for n in range(300)])
    assert all(own.lossless(texts, ids, offsets))
    parts = [own.encode(t, str(n)) for n, t in enumerate(texts)]
    assert [i for p in parts for i in p] == ids.tolist()
    held = sum(a.itemsize * len(a) for a in vars(own).values() if isinstance(a, array))
    assert held <= 16 * len(own.edge)
