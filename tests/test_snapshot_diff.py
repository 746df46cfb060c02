from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators.snapshot_diff import ordinals, snapshot_changes

SCHEMA = "k string, day date, a int, b string, seq int, change_kind string, _no int"
HOW = {"key": "k", "snapshot": "day", "values": ["a", "b"], "latest_by": ["seq"]}


def changes(spark, rows, **extra):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    return {(r.k, r.day.day, r.change_kind) for r in snapshot_changes(df, **HOW, **extra).collect()}


def brute(rows):
    state, best = {}, {}
    for k, day, a, b, seq in rows:
        if k is None or day is None:
            continue
        rank = (seq is not None, seq or 0, a is not None, a or 0, b is not None, b or "")
        if (day, k) not in best or rank > best[day, k]:
            best[day, k], state[day, k] = rank, (a, b)
    days = sorted({d for _, d, *_ in rows if d})
    out = set()
    for before, day in zip(days, days[1:]):
        for k in {k for k, *_ in rows if k}:
            x, y = state.get((before, k), "none"), state.get((day, k), "none")
            if x != y:
                out.add((k, day.day, "added" if x == "none" else "removed" if y == "none" else "changed"))
    return out


def test_added_removed_changed_and_nulls(spark):
    d = [date(2025, 1, i) for i in (1, 2, 5)]
    rows = [("x", d[0], 1, None, 1), ("y", d[0], 1, "b", 1), ("x", d[1], None, None, 1), ("z", d[1], 1, "b", 1), ("z", d[2], 1, "b", 2), ("z", d[2], 9, "b", 1), (None, d[2], 1, "b", 1), ("x", None, 1, "b", 1)]
    assert changes(spark, rows) == {("x", 2, "changed"), ("y", 2, "removed"), ("z", 2, "added"), ("x", 5, "removed")}


def test_more_keys_than_a_word_and_repeated_rows(spark):
    days = [date(2025, 1, i) for i in range(1, 5)]
    rows = [(f"k{i:03d}", d, i * (d.day if i % 7 == 0 else 1), "v", 1) for i in range(200) for d in days if (i * d.day) % 11]
    assert changes(spark, rows + rows[:50]) == brute(rows)


def test_empty_table_and_single_snapshot(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("x", date(2025, 1, 1), 1, "b", 1)]) == set()


def test_ordinals_are_dense_and_persistent(spark, tmp_path):
    keys, at = lambda names: spark.createDataFrame([(n,) for n in names], "_key string"), str(tmp_path / "keys")
    read = lambda: {r._key: r.ordinal for r in spark.read.parquet(at).collect()}
    ordinals(keys(["a", "b", None, "a"]), "_key", at)
    old = read()
    assert sorted(old.values()) == [0, 1]
    ordinals(keys(["c", "a", "d"]), "_key", at)
    both = read()
    assert {k: both[k] for k in old} == old and sorted(both.values()) == [0, 1, 2, 3]
    ordinals(keys(["c", None]), "_key", at)
    rows = [("a", date(2025, 1, 1), 1, "", 1), ("b", date(2025, 1, 2), 1, "", 1)]
    for _ in range(2):  # a second run finds the keys of the first
        assert changes(spark, rows, dictionary=at) == {("a", 2, "removed"), ("b", 2, "added")} and read() == both
    assert changes(spark, [*rows, ("e", date(2025, 1, 2), 1, "", 1)], dictionary=at) == {("a", 2, "removed"), ("b", 2, "added"), ("e", 2, "added")}
    assert read() == both | {"e": 4}


def test_nulls_in_different_columns_are_different(spark):
    d = [date(2025, 1, i) for i in (1, 2)]
    df = spark.createDataFrame([("x", d[0], None, 5, 1), ("x", d[1], 5, None, 1), ("y", d[0], 5, 5, 1), ("y", d[1], 5, 5, 1)], "k string, day date, a int, b int, seq int")
    assert [(r.k, r.change_kind) for r in snapshot_changes(df, **HOW).collect()] == [("x", "changed")]


row = st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from([date(2025, 1, i) for i in (1, 2, 3)]), st.sampled_from([None, 1, 2]), st.sampled_from([None, "", "x"]), st.integers(1, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=14))
def test_against_brute_force(spark, rows):
    assert changes(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [64, 65, 128])
def test_word_boundaries(spark, n):
    a, b = date(2025, 1, 1), date(2025, 1, 2)
    rows = [(f"{i:04d}", a, 1, "v", 1) for i in range(n)] + [(f"{i:04d}", b, 1 if i else 2, "v", 1) for i in range(n - 1)]
    assert changes(spark, rows) == brute(rows)
