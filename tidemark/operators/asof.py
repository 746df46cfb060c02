"""Attributes of an entity as known at each event's time.

Every attribute has its own change history (one row per observation in which it is known), matched on its
own; the matches are pivoted back onto the event, so that no wide version of all attributes is ever built and
attributes may change independently.

An observation may be used by an event when it was available and ingested in time and in effect on the
event's day; of those the latest by (effective from with null first, available, ingested, sequence) holds.
Histories and events of an entity are merged in time order in one pass. The state of the pass is, for each
attribute, the best observation so far of every event day, so its size follows the calendar and not the rows;
nothing but matches leaves the pass.

Entities with many events are split into consecutive time slices. A slice passes over its own part of the
history only and begins from the state that the earlier slices leave, which is carried over as one row per
day. So an entity with a third of all events and observations is neither read by one task nor copied to many:
its history is read twice, once for the states and once for the matches. Only events with two different
bounds, for which no state is small, are split by hash and meet the whole history of their entity in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

EVENTS_A_PIECE = 100_000
TWO_BOUND_EVENTS_A_PIECE = 2_000
LONGEST_CALENDAR = 100_000  # days between the first and the last event
CUTS_A_TOP = 100
HOT_ENTITIES = 100_000  # at most so many split entities are broadcast; with more the piece counts are joined by a shuffle
NO_DATE = -(1 << 40)

#: How an event sees the history: by availability, by availability and ingestion at one instant, or by two instants.
BY_AVAILABILITY, BY_BOTH, BY_TWO_BOUNDS = 0, 1, 2


def _day_number(c: Column) -> Column:
    return F.unix_date(c).cast("long")


class _DayBest:
    """For every event day the best observation so far of one attribute."""

    FIELDS = 4  # effective from, available, ingested, sequence

    def __init__(self, days: int):
        self.rank = np.full((self.FIELDS, days), np.iinfo(np.int64).min)
        self.at = np.full(days, -1, dtype=np.int64)
        self.values: list[str] = []

    def put(self, low: int, high: int, rank: tuple[int, ...], value: str) -> None:
        if low >= high:
            return
        held = self.rank[:, low:high]
        better, equal = np.zeros(high - low, dtype=bool), np.ones(high - low, dtype=bool)
        for have, new in zip(held, rank):
            better |= equal & (have < new)
            equal &= have == new
        if better.any():
            held[:, better] = np.asarray(rank)[:, None]
            self.at[low:high][better] = len(self.values)
            self.values.append(value)
            if len(self.values) > 2 * len(self.at) + 1024:  # forget what no day holds any more
                used, place = np.unique(self.at, return_inverse=True)
                self.values = [self.values[i] for i in used if i >= 0]
                self.at = place.reshape(-1) - int(used[0] < 0)


def attributes_as_of(
    events: DataFrame,
    observations: DataFrame,
    *,
    entity: str,
    event_keys: list[str],
    known_by: Column,
    on_day: Column,
    ingested_by: Column | None = None,
    available: Column,
    ingested: Column,
    effective_from: Column,
    effective_to: Column,
    sequence: Column,
    attributes: dict[str, Column],
    events_a_piece: int = EVENTS_A_PIECE,
) -> DataFrame:
    """One row per event that has any attribute: ``event_keys`` and one string column per attribute.

    An observation counts for an event of the same ``entity`` if ``available <= known_by``, ``ingested <= ingested_by``
    (where that is not null), ``effective_from`` is null or on or before ``on_day`` and ``effective_to`` is null or after
    it. An attribute's history holds only observations in which the attribute is not null; an attribute without a match
    is null. Events without entity, time or day, and observations without entity or either time, match nothing. Repeated
    events give repeated rows. Ties beyond the sequence go to the first met.
    """
    spark, names = events.sparkSession, list(attributes)
    late = ingested_by if ingested_by is not None else F.lit(None).cast("timestamp")
    lane = F.when(late.isNull(), BY_AVAILABILITY).when(known_by == late, BY_BOTH).otherwise(BY_TWO_BOUNDS)
    asked = events.where(known_by.isNotNull()).select(
        F.col(entity).cast("string").alias("_entity"),
        lane.alias("_lane"),
        F.unix_micros(known_by).alias("_t"),
        F.unix_micros(late).alias("_u"),
        _day_number(on_day).alias("_day"),
        F.struct(*event_keys).alias("_key"),
    ).where("_entity IS NOT NULL AND _day IS NOT NULL")

    limit = F.when(F.col("_lane") == BY_TWO_BOUNDS, min(events_a_piece, TWO_BOUND_EVENTS_A_PIECE)).otherwise(events_a_piece)
    counts = asked.groupBy("_entity", "_lane").agg(F.count("*").alias("_n"), F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    pieces = counts.withColumn("_pieces", F.ceil(F.col("_n") / limit).cast("int"))
    most, first, last, lanes = pieces.agg(F.max("_pieces"), F.min("_first"), F.max("_last"), F.sort_array(F.collect_set("_lane"))).first()
    if first is None:
        days = np.zeros(0, dtype=np.int64)
    elif last - first < LONGEST_CALENDAR:
        days = np.arange(first, last + 1)
    else:  # stray dates: only the days that occur, whose number the calendar bounds
        days = np.array(sorted(r[0] for r in asked.select("_day").distinct().collect()), dtype=np.int64)
    # Only entities that are split: at most one per ``events_a_piece`` events. Beyond HOT_ENTITIES they are joined by a shuffle.
    split, hot = pieces.where("_pieces > 1").select("_entity", "_lane", "_pieces"), (most or 1) > 1
    if hot:
        rows = split.limit(HOT_ENTITIES + 1).collect()
        few = len(rows) <= HOT_ENTITIES
        split = _with_cuts(asked, F.broadcast(spark.createDataFrame(rows, split.schema)) if few else split, most)
        split = F.broadcast(cut_lineage(split)) if few else cut_lineage(split)
    by_hash = F.col("_lane") == BY_TWO_BOUNDS

    def placed(df: DataFrame, order: str) -> DataFrame:
        """Adds the number of the entity's pieces, and the time slice that ``order`` falls into."""
        if not hot:
            return df.withColumn("_pieces", F.lit(1)).withColumn("_piece", F.lit(0))
        joined = df.join(split, ["_entity", "_lane"], "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
        return joined.withColumn("_piece", _slice_of(F.col(order))).drop("_cuts", "_tops")

    key_type = asked.schema["_key"].dataType.simpleString()
    no = lambda kind: F.lit(None).cast(kind)
    asked = placed(asked.withColumn("_order", F.when(by_hash, F.lit(NO_DATE).cast("long")).otherwise(F.col("_t"))), "_order").select(
        "_entity", "_lane", F.when(by_hash, F.pmod(F.xxhash64("_key"), F.col("_pieces")).cast("int")).otherwise(F.col("_piece")).alias("_piece"), "_order", F.lit(1).alias("_kind"),
        F.col("_day").alias("_low"), no("long").alias("_high"), no("long").alias("_a"), F.col("_t").alias("_b"), F.col("_u").alias("_c"), no("long").alias("_seq"), no("int").alias("_attr"), no("string").alias("_value"), "_key",
    )
    order = F.when(F.col("_lane") == BY_BOTH, F.greatest("_av", "_in")).otherwise(F.col("_av"))
    history = (
        observations.select(
            F.col(entity).cast("string").alias("_entity"), available.alias("_av"), ingested.alias("_in"), _day_number(effective_from).alias("_from"), _day_number(effective_to).alias("_to"), sequence.cast("long").alias("_seq"),
            F.explode(F.array(*[F.struct(F.lit(i).alias("attr"), c.cast("string").alias("value")) for i, c in enumerate(attributes.values())])).alias("_x"),
        )
        .where("_entity IS NOT NULL AND _av IS NOT NULL AND _in IS NOT NULL AND _x.value IS NOT NULL")
        .withColumn("_lane", F.explode(F.array(*[F.lit(n) for n in lanes]) if lanes else F.array().cast("array<int>")))  # the lanes that events ask for
        .withColumn("_order", F.unix_micros(order))
    )
    history = placed(history, "_order").select(
        "_entity", "_lane", "_piece", "_order", F.lit(0).alias("_kind"), F.coalesce("_from", F.lit(NO_DATE)).alias("_low"), F.coalesce("_to", F.lit(-NO_DATE)).alias("_high"),
        F.coalesce("_from", F.lit(NO_DATE)).alias("_a"), F.unix_micros("_av").alias("_b"), F.unix_micros("_in").alias("_c"), F.coalesce("_seq", F.lit(0)).alias("_seq"), F.col("_x.attr").alias("_attr"), F.col("_x.value").alias("_value"), no(key_type).alias("_key"), "_pieces",
    )
    if hot:
        carried = _carried(history.where((F.col("_pieces") > 1) & ~by_hash).drop("_key"), days, len(names))
        every_piece = F.explode(F.when(by_hash, F.sequence(F.lit(0), F.col("_pieces") - 1)).otherwise(F.array("_piece")))
        history = history.withColumn("_piece", every_piece).unionByName(carried.withColumn("_key", no(key_type)).withColumn("_pieces", F.lit(0)))
    history = history.drop("_pieces")
    stream = history.unionByName(asked).repartition(*GROUP).sortWithinPartitions(*GROUP, "_order", "_kind")
    shape = ", ".join([f"`_key` {key_type}", *(f"`{n}` string" for n in names)])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _Merge(days, names)
        for batch in batches:
            yield from merge.take(batch)
        yield from merge.finish()

    matched = stream.mapInArrow(match, shape)
    return matched.select("_key.*", *names)


GROUP = ["_entity", "_lane", "_piece"]
STATE = ["_a", "_b", "_c", "_seq", "_value"]


def _with_cuts(asked: DataFrame, split: DataFrame, most: int) -> DataFrame:
    """``(entity, lane, pieces, cuts)``: the instants at which the time slices of each split entity begin after the first."""
    fine = min(most, 10_000)
    quantiles = F.percentile_approx("_t", F.array(*[F.lit(i / fine) for i in range(1, fine)]), 10 * fine) if fine > 1 else F.array()
    cut = asked.join(split, ["_entity", "_lane"]).groupBy("_entity", "_lane", "_pieces").agg(quantiles.alias("_q"))
    own = F.least(F.col("_pieces"), F.lit(fine))
    chosen = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("_q", F.ceil(i * fine / own).cast("int") - 1))
    cuts = cut.select("_entity", "_lane", "_pieces", F.when(F.col("_lane") != BY_TWO_BOUNDS, F.array_distinct(chosen)).alias("_cuts"))
    return cuts.withColumn("_tops", F.filter("_cuts", lambda c, i: i % CUTS_A_TOP == 0))


def _slice_of(order: Column) -> Column:
    """How many cuts are at or before ``order``: among every 100th cut first, then among the 100 that follow the last of those."""
    upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= order))
    top = upto(F.col("_tops"))
    begin = (top - 1) * CUTS_A_TOP
    return F.when(F.col("_cuts").isNull() | (top < 1), 0).otherwise(begin + upto(F.slice("_cuts", F.greatest(begin, F.lit(0)) + 1, CUTS_A_TOP)))


def _carried(history: DataFrame, days: np.ndarray, width: int) -> DataFrame:
    """What each time slice inherits: for every attribute and day the best observation of the earlier slices.

    A slice's own state has at most one row per attribute and day; later slices that leave a day as it was are filled in.
    """
    shape = "_entity string, _lane int, _piece int, _pieces int, _attr int, _low long, _a long, _b long, _c long, _seq long, _value string"

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _SliceStates(days, [""] * width)
        for batch in batches:
            yield from merge.take(batch)
        yield from merge.finish()

    own = history.repartition(*GROUP).sortWithinPartitions(*GROUP, "_order", "_kind").mapInArrow(states, shape)
    own = cut_lineage(own.withColumn("_state", F.struct(*STATE)).drop(*STATE))
    place = ["_entity", "_lane", "_attr", "_low"]
    later = own.groupBy(*place, "_pieces").agg(F.min("_piece").alias("_first")).where("_first + 1 < _pieces")
    filled = later.select(*place, F.explode(F.sequence(F.col("_first") + 1, F.col("_pieces") - 1)).alias("_piece"))
    both = own.select(*place, "_piece", "_state").unionByName(filled.withColumn("_state", F.lit(None).cast(own.schema["_state"].dataType)))
    each = both.groupBy(*place, "_piece").agg(F.max("_state").alias("_state"))
    before = Window.partitionBy(*place).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_state", F.max("_state").over(before)).where("_state IS NOT NULL")
    return carried.select("_entity", "_lane", "_piece", F.lit(NO_DATE).cast("long").alias("_order"), F.lit(0).alias("_kind"), "_low", (F.col("_low") + 1).alias("_high"), "_attr", "_state.*")


class _Merge:
    """The pass over the sorted stream of one partition."""

    def __init__(self, days: np.ndarray, names: list[str]):
        self.days, self.names = days, names
        self.group: tuple | None = None
        self.waiting: list[tuple] = []

    def _begin(self, group: tuple) -> None:
        self.group = group
        self.best = [_DayBest(len(self.days)) for _ in self.names] if group[1] != BY_TWO_BOUNDS else []
        self.waiting: list[tuple] = []
        self.questions: list[pa.RecordBatch] = []

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        n = batch.num_rows
        if not n:
            return
        codes = pc.dictionary_encode(col["_entity"]).indices.to_numpy(zero_copy_only=False)
        lane, piece = (col[c].to_numpy(zero_copy_only=False) for c in ("_lane", "_piece"))
        turns = np.flatnonzero((codes[1:] != codes[:-1]) | (lane[1:] != lane[:-1]) | (piece[1:] != piece[:-1])) + 1
        num = {c: col[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("_kind", "_low", "_high", "_a", "_b", "_c", "_seq", "_attr")}
        low = np.searchsorted(self.days, num["_low"], side="left")
        high = np.searchsorted(self.days, num["_high"], side="left")
        for start, end in zip([0, *turns], [*turns, n]):
            group = (col["_entity"][start].as_py(), int(lane[start]), int(piece[start]))
            if group != self.group:
                yield from self.finish()
                self._begin(group)
            step = self._by_time if group[1] != BY_TWO_BOUNDS else self._by_two_bounds
            yield from step(col, num, low, high, start, end)

    def _by_time(self, col, num, low, high, start, end) -> Iterator[pa.RecordBatch]:
        kinds = num["_kind"][start:end]
        asks = np.flatnonzero(kinds == 1)
        news = np.flatnonzero(kinds == 0)
        if len(news):
            values = col["_value"].slice(start, end - start).take(pa.array(news)).to_pylist()
            at = news + start
            rows = list(zip(news.tolist(), num["_attr"][at].tolist(), low[at].tolist(), high[at].tolist(), zip(num["_a"][at].tolist(), num["_b"][at].tolist(), num["_c"][at].tolist(), num["_seq"][at].tolist()), values))
        else:
            rows = []
        if not len(asks):
            self.waiting += rows  # applied only if an event follows
            if len(self.waiting) > 50_000:
                self._apply()
            return
        self._apply()
        found = [np.full(len(asks), -1, dtype=np.int64) for _ in self.names]
        texts: list[list[str]] = [[] for _ in self.names]
        cuts = np.searchsorted(news, asks)  # how many of the rows precede each event
        done = 0
        for at in np.unique(cuts):
            for row in rows[done:at]:
                self.best[row[1]].put(row[2], row[3], row[4], row[5])
            done = at
            first, last = np.searchsorted(cuts, at, "left"), np.searchsorted(cuts, at, "right")
            where = low[start + asks[first:last]]
            for best, out, text in zip(self.best, found, texts):
                hit = best.at[where]
                out[first:last] = np.where(hit >= 0, hit + len(text), -1) if len(best.values) <= 64 else self._own(hit, best, text)
                if len(best.values) <= 64:
                    text += best.values
        self.waiting = rows[done:]
        yield from self._out(col["_key"].take(pa.array(asks + start)), found, texts)

    @staticmethod
    def _own(hit: np.ndarray, best: _DayBest, text: list[str]) -> np.ndarray:
        used, place = np.unique(hit, return_inverse=True)
        shift = len(text) - int(used[0] < 0)
        text += [best.values[i] for i in used if i >= 0]
        return np.where(hit >= 0, place.reshape(-1) + shift, -1)

    def _apply(self) -> None:
        for row in self.waiting:
            self.best[row[1]].put(row[2], row[3], row[4], row[5])
        self.waiting = []

    def _out(self, keys: pa.Array, found: list[np.ndarray], texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        keep = np.flatnonzero(np.any([f >= 0 for f in found], axis=0))
        if len(keep):
            columns = [pa.array(t, pa.string()).take(pa.array(f[keep], pa.int64(), mask=f[keep] < 0)) for f, t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(keep)), *columns], names=["_key", *self.names])

    def _by_two_bounds(self, col, num, low, high, start, end) -> Iterator[pa.RecordBatch]:
        """Events come first, a bounded number a piece; then the history passes by in blocks."""
        kinds = num["_kind"][start:end]
        asks = np.flatnonzero(kinds == 1) + start
        if len(asks):
            self.questions.append((low[asks], num["_b"][asks], num["_c"][asks], col["_key"].take(pa.array(asks))))
        news = np.flatnonzero(kinds == 0) + start
        if not len(news) or not self.questions:
            return iter(())
        if not self.best:
            self.day, self.known, self.stored = (np.concatenate([q[i] for q in self.questions]) for i in range(3))
            self.best = [([None] * len(self.day), [None] * len(self.day)) for _ in self.names]
        for block in np.array_split(news, -(-len(news) // 512)):
            rank = np.lexsort((num["_seq"][block], num["_c"][block], num["_b"][block], num["_a"][block]))[::-1]
            block = block[rank]
            fits = (num["_b"][block] <= self.known[:, None]) & (num["_c"][block] <= self.stored[:, None]) & (low[block] <= self.day[:, None]) & (self.day[:, None] < high[block])
            for i, (ranks, values) in enumerate(self.best):
                own = fits & (num["_attr"][block] == i)
                first = own.argmax(axis=1)
                for q in np.flatnonzero(own.any(axis=1)):
                    at = int(block[first[q]])
                    mine = (num["_a"][at], num["_b"][at], num["_c"][at], num["_seq"][at])
                    if ranks[q] is None or mine > ranks[q]:
                        ranks[q], values[q] = mine, col["_value"][at].as_py()
        return iter(())

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.group is None or self.group[1] != BY_TWO_BOUNDS or not self.best:
            return
        keys = pa.concat_arrays([q[3] for q in self.questions])
        found = [np.array([i if v is not None else -1 for i, v in enumerate(values)], dtype=np.int64) for _, values in self.best]
        yield from self._out(keys, found, [values for _, values in self.best])
        self.best, self.questions = [], []


class _SliceStates(_Merge):
    """The pass over observations alone, which emits the state that each slice leaves."""

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            each = pa.Table.from_batches([batch.select([*GROUP, "_pieces"])]).group_by(GROUP).aggregate([("_pieces", "max")])
            of = dict(zip(zip(*(each.column(c).to_pylist() for c in GROUP)), each.column("_pieces_max").to_pylist()))
            self.of = of | ({self.group: self.of[self.group]} if self.group else {})
        yield from super().take(batch)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.group is None:
            return
        self._apply()
        for i, best in enumerate(self.best):
            on = np.flatnonzero(best.at >= 0)
            if len(on):
                fixed = [pa.array([v] * len(on), kind) for v, kind in zip((*self.group, self.of[self.group], i), (pa.string(), *[pa.int32()] * 4))]
                ranks = [pa.array(r[on], pa.int64()) for r in best.rank]
                values = pa.array([best.values[k] for k in best.at[on]], pa.string())
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(self.days[on], pa.int64()), *ranks, values], names=["_entity", "_lane", "_piece", "_pieces", "_attr", "_low", "_a", "_b", "_c", "_seq", "_value"])
