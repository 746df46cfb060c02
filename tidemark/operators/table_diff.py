"""Differences between two copies of a table, for keys that may have several rows on either side.

1. Identical rows (key and all compared fields) are cancelled by multiplicity: one grouping of both copies with
   the counts +1 and -1, which combines on the map side, so a hot key or a row repeated a billion times is no problem.
2. What is left over is paired within each key so that the number of differing fields is least. Keys with one distinct row
   a side, or with rows of one copy only, leave no choice: the first are paired by a second map-side-combined grouping, the
   second never come together. All others are solved at least cost: few rows by assignment, more by minimum-cost flow over
   the distinct rows with their multiplicities. Such a key's distinct left-over rows meet in one task.
"""

from __future__ import annotations

from collections import defaultdict, deque
from functools import reduce
from heapq import heappop, heappush
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ASSIGNMENT_LIMIT = 400  # left-over rows of one key and side that are paired by assignment; more, also of one distinct row, by flow


def least_cost_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of all rows of the smaller side (shortest augmenting paths with potentials)."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in least_cost_pairs(cost.T)]
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)  # the row that holds a column, 1-based
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[j0] = True
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(done, np.inf, slack)))
            delta = slack[j1]
            u[owner[done]] += delta
            v[done] -= delta
            slack[~done] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def least_cost_flows(left: np.ndarray, left_n: list[int], right: np.ndarray, right_n: list[int]) -> list[tuple[int, int, int]]:
    """``(i, j, times)``: all copies of the smaller side paired so that the number of differing fields is least.

    A left row flows to a right row through a node for the values of any set of fields that both hold; what it costs is the
    number of the other fields. The edges are as many as rows times sets of fields, not pairs of rows. The node of the empty
    set joins all, so a shortest path costs at most the number of fields, and as many rounds of maximum flow over shortest
    paths are enough.
    """
    fields = left.shape[1]
    shared: list[dict] = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(shared, (left, right)):
        for i, row in enumerate(rows.tolist()):
            for mask in range(1 << fields):
                side[mask, tuple(v for f, v in enumerate(row) if mask >> f & 1)].append(i)
    both = [k for k in shared[0] if k in shared[1]]
    n, m = len(left), len(right)
    source, sink = n + m + len(both), n + m + len(both) + 1
    head, room, cost, edges = [], [], [], [[] for _ in range(sink + 1)]

    def add(u: int, v: int, most: int, price: int) -> int:
        edges[u].append(len(head))
        edges[v].append(len(head) + 1)
        head.extend((v, u)), room.extend((most, 0)), cost.extend((price, -price))
        return len(head) - 1  # its room is the flow

    for i in range(n):
        add(source, i, left_n[i], 0)
    for j in range(m):
        add(n + j, sink, right_n[j], 0)
    wanted = min(sum(left_n), sum(right_n))
    flows = []
    for at, k in enumerate(both, n + m):
        price = fields - k[0].bit_count()
        flows.append(([(i, add(i, at, left_n[i], price)) for i in shared[0][k]], [(j, add(at, n + j, right_n[j], 0)) for j in shared[1][k]]))
    potential, done = [0] * (sink + 1), 0
    while done < wanted:
        far = [np.inf] * (sink + 1)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, u = heappop(heap)
            if u == sink:
                break
            if d > far[u]:
                continue
            for e in edges[u]:
                v = head[e]
                if room[e] and d + cost[e] + potential[u] - potential[v] < far[v]:
                    far[v] = d + cost[e] + potential[u] - potential[v]
                    heappush(heap, (far[v], v))
        potential = [p + min(d, far[sink]) for p, d in zip(potential, far)]
        while True:  # a maximum flow over the shortest paths
            level, queue = [-1] * (sink + 1), deque([source])
            level[source] = 0
            while queue and level[sink] < 0:
                u = queue.popleft()
                for e in edges[u]:
                    v = head[e]
                    if room[e] and level[v] < 0 and cost[e] + potential[u] == potential[v]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[sink] < 0:
                break
            tried, path, u = [0] * (sink + 1), [], source
            while True:
                if u == sink:
                    pushed = min(room[e] for e in path)
                    done += pushed
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    full = next(k for k, e in enumerate(path) if not room[e])
                    u = head[path[full] ^ 1]
                    del path[full:]
                while tried[u] < len(edges[u]):
                    e = edges[u][tried[u]]
                    if room[e] and level[head[e]] == level[u] + 1 and cost[e] + potential[u] == potential[head[e]]:
                        path.append(e)
                        u = head[e]
                        break
                    tried[u] += 1
                else:
                    if u == source:
                        break
                    level[u] = -1
                    u = head[path.pop() ^ 1]
    pairs: dict[tuple[int, int], int] = defaultdict(int)
    for come, go in flows:
        givers, takers = ([[i, room[e]] for i, e in side if room[e]] for side in (come, go))
        while givers:
            some = min(givers[-1][1], takers[-1][1])
            pairs[givers[-1][0], takers[-1][0]] += some
            for side in (givers, takers):
                side[-1][1] -= some
                if not side[-1][1]:
                    side.pop()
    return [(i, j, times) for (i, j), times in pairs.items()]


def leftovers(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``(keys, row, surplus, cancelled)``: rows that one copy has more often; a positive surplus is the left's.

    ``cancelled`` says whether the other copy holds the row as well, less often. Nulls are equal to nulls here. Other columns
    of the copies are ignored.
    """
    row = F.struct(*fields)
    both = left.select(*keys, row.alias("row"), F.lit(1).alias("n")).unionByName(right.select(*keys, row.alias("row"), F.lit(-1).alias("n")))
    counted = both.groupBy(*keys, "row").agg(F.sum("n").alias("surplus"), (F.min("n") < F.max("n")).alias("cancelled"))
    return counted.where("surplus <> 0")


def _assign(over: DataFrame, keys: list[str], fields: list[str], limit: int) -> DataFrame:
    """``(keys, l, r, copies, extra)``: minimum-cost pairs of keys with several left-over rows."""
    key_shape = ", ".join(f"`{k}` {over.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"f{i}" for i in range(len(fields))]
    text = over.select(
        *keys, F.to_json("row").alias("row"), *[F.col(f"row.`{f}`").cast("string").alias(n) for f, n in zip(fields, names)],
        F.abs("surplus").alias("copies"), (F.col("surplus") > 0).alias("is_left"), "cancelled",
    )

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["is_left", "row"], kind="stable")
        ours, theirs = group[group.is_left], group[~group.is_left]
        a, b = (side[names].astype(object).where(side[names].notna(), None).to_numpy() for side in (ours, theirs))
        of_a, of_b = ([int(n) for n in side.copies] for side in (ours, theirs))
        if max(sum(of_a), sum(of_b)) > limit:
            pairs = least_cost_flows(a, of_a, b, of_b)
        else:
            each_a, each_b = np.repeat(np.arange(len(a)), of_a), np.repeat(np.arange(len(b)), of_b)
            cost = (a[each_a][:, None, :] != b[each_b][None, :, :]).sum(axis=2).astype(float)
            pairs = [(each_a[i], each_b[j], 1) for i, j in least_cost_pairs(cost)]
        rows = []
        for i, j, n in pairs:
            rows.append((ours.row.iloc[i], theirs.row.iloc[j], n, False))
            of_a[i] -= n
            of_b[j] -= n
        for side, rest, at in ((ours, of_a, 0), (theirs, of_b, 1)):
            for row, n, copies, cancelled in zip(side.row, rest, side.copies, side.cancelled):
                if n:
                    rows.append((*(row if i == at else None for i in (0, 1)), n, bool(cancelled or n < copies)))
        out = pd.DataFrame(rows, columns=["l", "r", "copies", "extra"])
        for k in reversed(keys):
            out.insert(0, k, group[k].iloc[0])
        return out

    shape = over.schema["row"].dataType.simpleString()
    # A group costs time and few bytes, so the number of tasks is set, not left to the size of the rows.
    text = text.repartition(2 * over.sparkSession.sparkContext.defaultParallelism, *keys)
    paired = text.groupBy(*keys).applyInPandas(pair, f"{key_shape}, l string, r string, copies long, extra boolean")
    return paired.select(*keys, *[F.from_json(c, shape).alias(c) for c in ("l", "r")], "copies", "extra")


def paired_leftovers(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], *, repetitions: bool = True, limit: int = ASSIGNMENT_LIMIT) -> DataFrame:
    """``(keys, l, r)``: left-over rows after cancellation, in pairs of least difference; one side is null where none is left.

    Keys with left-over rows of one copy only, or with one distinct row a side, leave no choice and are paired without
    bringing their rows together; all others go through minimum-cost assignment, by flow with more than ``limit`` left-over
    rows of a key and side. Without ``repetitions``, copies that stay single although another copy of the same row was
    cancelled or paired are left out, and every other row or pair comes once. Rows with a null in a key are compared like any
    others. An empty copy makes every row of the other one-sided.
    """
    over = cut_lineage(leftovers(left, right, keys, fields))  # the differing rows alone; both copies are read once
    is_left, copies = F.col("surplus") > 0, F.abs("surplus")
    side = lambda of, value: F.when(of, value)
    summary = over.groupBy(*keys).agg(
        F.count_if(is_left).alias("_dl"), F.count_if(~is_left).alias("_dr"), F.sum(side(is_left, copies)).alias("_nl"), F.sum(side(~is_left, copies)).alias("_nr"),
        F.max(side(is_left, F.struct("row", "cancelled"))).alias("_l"), F.max(side(~is_left, F.struct("row", "cancelled"))).alias("_r"),
    )
    no_choice = "_dl <= 1 AND _dr <= 1"
    n = F.least("_nl", "_nr")
    null = F.lit(None).cast(over.schema["row"].dataType)
    part = lambda l, r, copies, extra: F.struct(l.alias("l"), r.alias("r"), copies.cast("long").alias("copies"), extra.alias("extra"))
    both, none = n.isNotNull() & F.col("_nl").isNotNull() & F.col("_nr").isNotNull(), F.lit(0)
    paired = F.when(both, n).otherwise(none)
    parts = F.array(
        part(F.col("_l.row"), F.col("_r.row"), paired, F.lit(False)),
        part(F.col("_l.row"), null, F.coalesce("_nl", none) - paired, F.coalesce("_l.cancelled", F.lit(False)) | both),
        part(null, F.col("_r.row"), F.coalesce("_nr", none) - paired, F.coalesce("_r.cancelled", F.lit(False)) | both),
    )
    simple = summary.where(no_choice).select(*keys, F.inline(F.filter(parts, lambda p: p["copies"] > 0)))
    marked = summary.where(f"NOT ({no_choice})").select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], (F.least("_dl", "_dr") == 0).alias("_one"))
    same = reduce(and_, [over[k].eqNullSafe(marked[f"_{i}"]) for i, k in enumerate(keys)])
    several = over.join(marked, same).select(*keys, "row", "surplus", "cancelled", "_one")
    whole = F.col("row")
    alone = several.where("_one").select(*keys, F.when(is_left, whole).alias("l"), F.when(~is_left, whole).alias("r"), copies.cast("long").alias("copies"), F.col("cancelled").alias("extra"))
    found = simple.unionByName(alone).unionByName(_assign(several.where("NOT _one").drop("_one"), keys, fields, limit))
    if not repetitions:
        return found.where("NOT extra").select(*keys, "l", "r")
    return found.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*keys, "l", "r")


def field_differences(pairs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``(keys, field_name, difference)``: ``row`` with ``only_left`` or ``only_right``, else ``value`` for each unequal field."""
    one_sided = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right")
    unequal = F.filter(
        F.array(*[F.when(~F.col(f"l.`{f}`").eqNullSafe(F.col(f"r.`{f}`")), F.lit(f)) for f in fields]), lambda f: f.isNotNull()
    )
    found = F.when(one_sided.isNotNull(), F.array(F.lit("row"))).otherwise(unequal)
    return pairs.select(*keys, F.explode(found).alias("field_name"), F.coalesce(one_sided, F.lit("value")).alias("difference"))
