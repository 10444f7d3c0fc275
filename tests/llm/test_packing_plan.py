"""The packing plan does not walk over single pieces."""

import signal
from collections import Counter

import pytest

from barloom.llm import packing


@pytest.fixture
def limit():
    signal.alarm(60)
    yield
    signal.alarm(0)


def pieces(plan):
    used = Counter()
    for config, n in plan:
        for m in config:
            used[m] += n
    return used


def fullest(rest, capacity):
    """The most that pieces beside one of the longest can fill, by trying all."""
    longest = max(rest)
    sums = {longest}
    for n in [n for n, k in rest.items() for _ in range(k - (n == longest))]:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_priced_rest_is_the_fullest_filling(rnd):
    for _ in range(300):
        rest = {n: rnd.randint(1, 9) for n in rnd.sample(range(1, 60), 8)}
        plan = packing._priced(rest, 60)
        assert pieces(plan) == Counter(rest)
        for config, n in plan:
            assert config[0] == max(rest) and sum(config) == fullest(rest, 60)
            rest = {m: k - n * config.count(m) for m, k in rest.items() if k > n * config.count(m)}
        assert not rest


def test_number_of_configurations_does_not_follow_the_pieces(limit, rnd):
    histogram = {n: rnd.randint(1, 10**9) for n in range(1, 4096, 3)}
    plan = packing.plan(histogram, 4096)
    assert pieces(plan) == Counter(histogram) and len(plan) < 40_000
    assert sum(n for _, n in plan) <= 1.01 * sum(n * k for n, k in histogram.items()) / 4096


def test_short_supply_of_fillers(limit):
    many = 10**10
    histogram = {2500: many, 2049: many // 2, 1500: many // 10, 96: many // 100, 7: 5}
    plan = packing.plan(histogram, 4096)
    assert pieces(plan) == Counter(histogram) and all(sum(c) <= 4096 for c, _ in plan)
    # no two of the long ones share a sequence, and all others fit beside them
    assert sum(n for _, n in plan) <= (many + many // 2) * 1.001
