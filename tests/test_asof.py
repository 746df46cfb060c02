import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.asof import attributes_as_of

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
EVENTS = "entity string, id long, known timestamp, stored timestamp, day date, _value string, meta int"
OBS = "entity string, av timestamp, ing timestamp, ef date, et date, seq long, x string, y string, _key string"


def run(spark, events, obs, **extra):
    e = spark.createDataFrame([(*r, "clash", 1) for r in events], EVENTS)
    o = spark.createDataFrame([(*r, "clash") for r in obs], OBS)
    out = attributes_as_of(
        e, o, entity="entity", event_keys=["id"], known_by=F.col("known"), ingested_by=F.col("stored"), on_day=F.col("day"), available=F.col("av"), ingested=F.col("ing"),
        effective_from=F.col("ef"), effective_to=F.col("et"), sequence=F.col("seq"), attributes={"x": F.col("x"), "y": F.col("y")}, **extra,
    )
    return sorted((r.id, r.x, r.y) for r in out.collect())


def brute(events, obs):
    out = []
    for entity, i, known, stored, day in events:
        found = []
        for pick in (6, 7):
            fits = [
                o for o in obs
                if entity and known and day and o[0] == entity and o[1] and o[2] and o[pick] is not None and o[1] <= known and (stored is None or o[2] <= stored) and (o[3] is None or o[3] <= day) and (o[4] is None or o[4] > day)
            ]
            best = max(fits, key=lambda o: (o[3] or date.min, o[1], o[2], o[5]), default=None)
            found.append(best[pick] if best else None)
        if any(v is not None for v in found):
            out.append((i, *found))
    return sorted(out)


def tables(seed, n_events=300, n_obs=120, entities="abc"):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(hours=r.randint(0, 900))
    day = lambda: date(2025, 1, 1) + timedelta(days=r.randint(-5, 40))
    events = []
    for i in range(n_events):
        stored = r.choice([None, at(), at()])
        known = stored if stored and r.random() < 0.5 else at()
        events.append((r.choice(entities), i, min(known, stored) if stored else known, stored, day()))
    obs = []
    for s in range(n_obs):
        a, f = at(), r.choice([None, day(), day()])
        obs.append((r.choice(entities), a, a + timedelta(hours=r.choice([0, 0, 50, 300])), f, r.choice([None, (f or date(2025, 1, 5)) + timedelta(days=r.randint(0, 20))]), s, r.choice([None, f"x{s}"]), r.choice([None, f"y{s}"])))
    return events, obs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    events, obs = tables(seed)
    assert run(spark, events, obs) == brute(events, obs)


def test_split_entities_and_many_values(spark):
    events, obs = tables(3, 400, 300, "a")
    for size in (37, 7):
        assert run(spark, events, obs, events_a_piece=size) == brute(events, obs)


def test_a_value_known_later_is_never_used(spark):
    day, later = date(2025, 1, 2), T0 + timedelta(days=9)
    obs = [("a", T0, T0, None, None, 1, "old", None), ("a", later, later, date(2025, 1, 1), None, 2, "new", "q")]
    assert run(spark, [("a", 1, T0, None, day), ("a", 2, later, None, day), ("a", 3, later, T0, day)], obs) == [(1, "old", None), (2, "new", "q"), (3, "old", None)]


def test_nulls_empties_repeats_and_equal_times(spark):
    day = date(2025, 1, 2)
    obs = [("a", T0, T0, None, None, 1, "v", None), ("a", T0, T0, None, None, 2, "w", None), (None, T0, T0, None, None, 3, "n", None), ("a", None, T0, None, None, 4, "n", None)]
    events = [("a", 1, T0, None, day), ("a", 1, T0, None, day), (None, 2, T0, None, day), ("a", 3, None, None, day), ("a", 4, T0, None, None), ("b", 5, T0, None, day), ("a", 6, T0 - timedelta(seconds=1), None, day)]
    assert run(spark, events, obs) == [(1, "w", None), (1, "w", None)]
    assert run(spark, [], obs) == [] and run(spark, events, []) == []


def test_effective_end_is_exclusive(spark):
    obs = [("a", T0, T0, date(2025, 1, 1), date(2025, 1, 3), 1, "v", None)]
    assert [i for i, *_ in run(spark, [("a", d, T0, None, date(2025, 1, d)) for d in (1, 2, 3)], obs)] == [1, 2]


def test_forgetting_unused_values():
    best = asof._DayBest(3)
    for i in range(3000):
        best.put(i % 3, 3, (i, 0, 0, 0), str(i))
    assert [best.values[i] for i in best.at] == ["2997", "2998", "2999"] and len(best.values) < 1100
