import random
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.clean import monday
from tidemark.operators.history import append_history, observed_versions, read_history, reconstruct, store, validity
from tidemark.operators.panes import pane_changes, window_corrections

BASE = date(2025, 1, 6)


def corrections(spark, rows, size=1, from_day=0, cut_off=21):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, day date, arrived date, seq int, v long, pane string")
    c = pane_changes(df, keys=["k"], item=["day"], pane=monday("day"), arrived_on=F.col("arrived"), latest_by=[F.col("arrived"), F.col("seq")], amount=F.col("v"), cut_off_days=cut_off)
    return sorted((r.k, r.window_start, r.observed_on, r.total) for r in window_corrections(c, keys=["k"], size=size, from_day=from_day).collect())


def brute(rows, size=1, from_day=0, cut_off=21):
    rows = [r for r in rows if None not in r[:3] and r[2] < r[1] - timedelta(r[1].weekday()) + timedelta(cut_off)]
    out = []
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        weeks = {r[1] - timedelta(r[1].weekday() + 7 * i) for r in own for i in range(size)}
        for w in weeks:
            in_window = [r for r in own if w <= r[1] < w + timedelta(7 * size)]
            before = 0
            for d in sorted({r[2] for r in in_window}):
                last = {}
                for r in sorted((r for r in in_window if r[2] <= d), key=lambda r: (r[2], r[3], r[4] or 0)):
                    last[r[1]] = r[4] or 0
                total = sum(last.values())
                if total != before and d >= w + timedelta(from_day):
                    out.append((k, w, d, total))
                before = total
    return sorted(out)


def test_late_rows_correct_a_week_until_the_cut_off(spark):
    d = lambda n: BASE + timedelta(n)
    rows = [("a", d(0), d(0), 1, 10), ("a", d(1), d(1), 1, 5), ("a", d(0), d(9), 2, 12), ("a", d(0), d(20), 3, None), ("a", d(0), d(21), 4, 99), (None, d(0), d(9), 1, 7), ("a", None, d(9), 1, 7)]
    assert corrections(spark, rows, from_day=7) == [("a", BASE, d(9), 17), ("a", BASE, d(20), 5)]
    assert corrections(spark, rows) == brute(rows)


def test_no_change_no_case_and_empty(spark):
    rows = [("a", BASE, BASE, 1, 10), ("a", BASE, BASE + timedelta(8), 2, 10), ("a", BASE, BASE + timedelta(8), 2, 10)]
    assert corrections(spark, rows, from_day=7) == [] and corrections(spark, []) == []


day = st.integers(0, 20).map(lambda n: BASE + timedelta(n))
row = st.tuples(st.sampled_from(["a", "b"]), day, st.integers(0, 45).map(lambda n: BASE + timedelta(n)), st.integers(1, 9), st.sampled_from([None, 0, 1, 2, 5]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=25), st.sampled_from([1, 4]))
def test_panes_against_brute_force(spark, rows, size):
    assert corrections(spark, rows, size=size) == brute(rows, size=size)


# --- history ---

SCHEMA = "k string, ef date, et date, seq int, idx string, fee decimal(6,4), patch string, period string"


ATTRIBUTES = ["idx", "fee"]


def observed(spark, rows):
    df = spark.createDataFrame([(k, f, t, s, i, fee and F_(fee), "clash", "clash") for k, f, t, s, i, fee in rows], SCHEMA)
    return observed_versions(df, entity="k", effective_from="ef", latest_by=["seq"], attributes={"idx": F.col("idx"), "fee": F.col("fee")}, effective_to=F.col("et"))


def spans(stored):
    out = validity(reconstruct(stored, entity="k", attributes=ATTRIBUTES), entity="k", attributes=ATTRIBUTES)
    return sorted((r.k, r.valid_from, r.valid_to or date.max, r.idx or "", str(r.fee) if r.fee is not None else "") for r in out.collect())


def periods(spark, rows, period="quarter"):
    return spans(store(observed(spark, rows), entity="k", attributes=ATTRIBUTES, period=period))


def F_(x):
    from decimal import Decimal

    return Decimal(x)


def history(rows):
    out = []
    for k in {r[0] for r in rows if r[0] and r[1]}:
        own = sorted((r for r in rows if r[0] == k and r[1]), key=lambda r: r[3])
        held = {"idx": None, "fee": None}
        versions = []
        for f in sorted({r[1] for r in own}):
            same = [r for r in own if r[1] == f]
            last = lambda i: next((r[i] for r in reversed(same) if r[i] is not None), None)  # noqa: B023, E731
            held = {"idx": last(4) if last(4) is not None else held["idx"], "fee": last(5) if last(5) is not None else held["fee"]}
            versions.append([f, last(2), held["idx"] or "", held["fee"] or ""])
        spans = []
        for v, after in zip(versions, [*versions[1:], None]):
            end = min(x for x in (v[1] or date.max, after[0] if after else date.max))
            if end > v[0]:
                spans.append([v[0], end, v[2], v[3]])
        merged = []
        for s in spans:
            if merged and merged[-1][1] == s[0] and merged[-1][2:] == s[2:]:
                merged[-1][1] = s[1]
            else:
                merged.append(s)
        out += [(k, *m) for m in merged]
    return sorted(out)


def test_patches_fold_over_checkpoints(spark):
    d = lambda m, n=1: date(2025, m, n)
    rows = [("a", d(1), None, 1, "i1", "0.5000"), ("a", d(2), None, 2, None, "0.6000"), ("a", d(5), None, 3, None, None), ("a", d(7), d(8), 4, "i2", None), ("a", d(9), None, 5, "i2", "0.6000"), (None, d(1), None, 1, "x", None), ("b", None, None, 1, "x", None)]
    want = [("a", d(1), d(2), "i1", "0.5000"), ("a", d(2), d(7), "i1", "0.6000"), ("a", d(7), d(8), "i2", "0.6000"), ("a", d(9), date.max, "i2", "0.6000")]
    assert periods(spark, rows) == want == history(rows)
    assert periods(spark, []) == []


version = st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 400).map(lambda n: date(2024, 1, 1) + timedelta(n)), st.one_of(st.none(), st.integers(100, 500).map(lambda n: date(2024, 1, 1) + timedelta(n))), st.integers(1, 10_000), st.sampled_from([None, "i", "j"]), st.sampled_from([None, "0.1000", "0.2000"]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(version, max_size=15, unique_by=lambda r: r[3]), st.sampled_from(["month", "quarter", "year"]))
def test_history_against_brute_force(spark, rows, period):
    assert periods(spark, rows, period) == history(rows)


def test_checkpoints_are_whole_and_patches_are_not(spark):
    rows = [("a", date(2025, m, 1), None, m, "i" if m in (1, 4) else None, "0.1000" if m == 1 else None) for m in range(1, 7)]
    stored = store(observed(spark, rows), entity="k", attributes=ATTRIBUTES).orderBy("effective_from").collect()
    assert [r.is_checkpoint for r in stored] == [True, False, False, True, False, False]
    assert [(bool(r.stated.idx), bool(r.stated.fee)) for r in stored] == [(True, True), (False, False), (False, False), (True, False), (False, False), (False, False)]
    assert [r.carried and (r.carried.idx, r.carried.fee and str(r.carried.fee)) for r in stored] == [(None, None), None, None, (None, "0.1000"), None, None]
    assert len({r.period for r in stored}) == 2


def test_the_store_grows_by_what_changes(spark, tmp_path):
    r = random.Random(4)
    day = lambda: date(2024, 1, 1) + timedelta(r.randint(0, 300))
    rows = [(r.choice("abc"), day(), r.choice([None, day()]), n, r.choice([None, "i", "j"]), r.choice([None, "0.1000", "0.2000"])) for n in range(60)]
    r.shuffle(rows)
    root, read = str(tmp_path / "history"), lambda: read_history(spark, str(tmp_path / "history"), "k")
    assert read() is None
    append = lambda some: append_history(spark, root, observed(spark, some), entity="k", attributes=ATTRIBUTES)
    for n, part in enumerate([rows[:25], rows[25:50], rows[50:]]):
        append(part)
        assert spans(read()) == history(rows[: (25, 50, 60)[n]])
    held = sorted(map(str, read().collect()))
    append(rows[10:30])  # seen before: no row is written
    assert spark.read.parquet(f"{root}/generation=3").count() == 0 and sorted(map(str, read().collect())) == held
    append([("c", date(2030, 1, 1), None, 99, "k", None)])
    assert spark.read.parquet(f"{root}/generation=4").count() == 1
    append([])
    assert len(spans(read())) > 5
