"""Packing follows the index as far as anything scores."""

import numpy as np

from sparkloom.llm import packing


def test_a_large_group_retrieves_itself():
    docs = [np.array([1, 2, 3]) if i % 2 == 0 else np.array([10 + i, 11 + i % 4, 60]) for i in range(12)]
    assert list(packing.order_of(docs, 18))[:6] == [0, 2, 4, 6, 8, 10]


def test_neighbours_beyond_the_64th_fill_the_window():
    docs = [np.array([i % 5]) for i in range(500)]
    assert {i % 5 for i in list(packing.order_of(docs, 90))[:90]} == {0}


def test_every_term_of_the_seed_counts():
    docs = [np.arange(40)]
    for i in range(40):
        docs += [np.array([i]), np.array([100 + i // 2])]
    got = list(packing.order_of(docs, 80))[:41]
    assert got[0] == 0 and {len(docs[j]) and docs[j][0] < 40 for j in got} == {True}


def test_best_first_is_the_full_order():
    scores = np.random.default_rng(3).integers(0, 9, 3000).astype(np.float32)
    want = sorted((j for j in range(3000) if scores[j] > 0), key=lambda j: (-scores[j], j))
    assert list(packing.best_first(scores)) == want
