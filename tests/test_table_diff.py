import random
from itertools import permutations

import numpy as np
import pytest

from tidemark.operators.table_diff import field_differences, least_cost_pairs, paired_leftovers

SCHEMA = "k string, f int, g string, h double, row string, surplus int, l string"


def tables(spark, *sides):
    return [spark.createDataFrame([(*r, "clash", 1, "clash") for r in side], SCHEMA) for side in sides]


def pairs(spark, left, right, **how):
    a, b = tables(spark, left, right)
    return paired_leftovers(a, b, ["k"], ["f", "g", "h"], **how)


def found(spark, left, right, **how):
    return sorted((r.k or "", r.field_name, r.difference) for r in field_differences(pairs(spark, left, right, **how), ["k"], ["f", "g", "h"]).collect())


def test_assignment_is_least_cost():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 5), (4, 4), (6, 3), (5, 6)]:
        cost = rng.integers(0, 4, (n, m)).astype(float)
        got = least_cost_pairs(cost)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
        assert sum(cost[i, j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)


def test_one_sided_unequal_and_null_values(spark):
    left = [("a", 1, "x", 1.0), ("b", 1, None, None), ("c", 1, "x", 2.0), ("e", None, None, None)]
    right = [("a", 1, "x", 1.0), ("b", 1, "y", None), ("d", 1, "x", 2.0), ("e", None, None, None)]
    want = [("b", "g", "value"), ("c", "row", "only_left"), ("d", "row", "only_right")]
    assert found(spark, left, right) == want
    assert found(spark, left, right, repetitions=False) == want


def test_identical_rows_cancel_by_multiplicity(spark):
    row = ("a", 1, "x", 1.0)
    assert found(spark, [row] * 3, [row] * 3) == []
    assert found(spark, [row] * 3, [row]) == [("a", "row", "only_left")] * 2


def test_repetitions_of_a_row_that_took_part_are_no_difference(spark):
    row, other, third = ("a", 1, "x", 1.0), ("a", 2, "x", 1.0), ("a", 3, "y", 2.0)
    once = lambda left, right: sorted(set(found(spark, left, right, repetitions=False)))
    assert once([row] * 3, [row]) == [] and once([row], [row] * 2) == []
    assert once([row] * 3, [other]) == [("a", "f", "value")]
    assert once([row] * 3, []) == [("a", "row", "only_left")]
    assert once([row, third], [row]) == [("a", "row", "only_left")]  # the third row took no part
    assert once([row] * 2 + [third] * 2, [other]) == [("a", "f", "value"), ("a", "row", "only_left")]
    assert once([row, other], [third]) == [("a", "f", "value"), ("a", "g", "value"), ("a", "h", "value"), ("a", "row", "only_left")]


def test_rows_of_one_copy_keep_their_multiplicity(spark):
    rows = pairs(spark, [("a", 1, "x", 1.0)] * 3 + [("a", 2, "x", 1.0)] * 2, [("b", 1, "x", 1.0)]).collect()
    assert sorted((r.k, bool(r.l)) for r in rows) == [("a", True)] * 5 + [("b", False)]


def test_null_keys_and_empty_copies(spark):
    assert found(spark, [(None, 1, "x", 1.0)], [(None, 2, "x", 1.0)]) == [("", "f", "value")]
    assert found(spark, [], []) == []
    assert found(spark, [], [("a", 1, "x", 1.0)]) == [("a", "row", "only_right")]


def cost_of(rows):
    return sum(sum(x != y for x, y in zip(r.l, r.r)) for r in rows if r.l and r.r)


def test_duplicate_keys_are_paired_at_least_cost(spark):
    r = random.Random(5)
    side = lambda n: [("k", r.randint(0, 2), r.choice("xyz"), float(r.randint(0, 2))) for _ in range(n)]
    for n, m in [(5, 5), (3, 6)]:
        left, right = side(n), side(m)
        rows = pairs(spark, left, right).collect()
        rest_l, rest_r = list(left), list(right)
        for row in left:
            if row in rest_r:
                rest_r.remove(row)
                rest_l.remove(row)
        short, long = sorted((rest_l, rest_r), key=len)
        best = min((sum(sum(x != y for x, y in zip(s[1:], o[1:])) for s, o in zip(short, p)) for p in permutations(long, len(short))), default=0)
        assert cost_of(rows) == best
        assert sum(1 for x in rows if x.l) == len(rest_l) and sum(1 for x in rows if x.r) == len(rest_r)


@pytest.mark.parametrize("limit", [0, 400])
def test_large_groups_report_every_row(spark, limit):
    left = [("k", i % 3, "x", float(i)) for i in range(12)]
    right = [("k", i % 2, "x", float(i)) for i in range(3, 13)]
    rows = pairs(spark, left, right, limit=limit).collect()
    cancelled = len(set(left) & set(right))
    assert sum(1 for x in rows if x.l) == 12 - cancelled and sum(1 for x in rows if x.r) == 10 - cancelled
    assert sum(1 for x in rows if x.l and x.r) == 10 - cancelled


def test_large_groups_are_paired_at_least_cost(spark):
    left, right = [("k", 1, "2", 3.0), ("k", 1, "5", 4.0)], [("k", 1, "2", 4.0), ("k", 8, "2", 3.0)]
    assert cost_of(pairs(spark, left, right, limit=0).collect()) == 2
    r = random.Random(7)
    sides = [[("abc"[i % 3], r.randint(0, 5), r.choice(["x", "y", None]), float(r.randint(0, 5))) for i in range(n)] for n in (90, 120)]
    flow, assignment = (pairs(spark, *sides, limit=limit).collect() for limit in (0, 400))
    for k in "abc":
        assert cost_of([x for x in flow if x.k == k]) == cost_of([x for x in assignment if x.k == k])
    assert sum(1 for x in flow if x.l and x.r) == sum(1 for x in assignment if x.l and x.r) and len(flow) == len(assignment)


def test_a_row_repeated_beyond_the_limit_is_paired_at_least_cost(spark):
    left = [("k", 1, "x", 1.0)] * 401 + [("k", 1, "5", 9.0)]
    right = [("k", 1, "x", 2.0), ("k", 1, "5", 1.0)]
    rows = pairs(spark, left, right).collect()
    assert len(rows) == 402 and cost_of(rows) == 2 and sum(1 for x in rows if x.l and x.r) == 2
