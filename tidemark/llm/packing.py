"""Filling containers of permitted capacities with items of whole-number sizes.

No container or item meets another in one task. The sizes are at most the largest capacity, so a histogram of sizes is
bounded by it whatever the number of items, and variable-capacity best-fit runs over the histogram. The largest item left
opens a container: for every permitted capacity the container is completed with the best-fitting items left, the capacity of
least cost per token is opened, and the container is downsized to the least capacity that holds its contents. The same
contents are repeated as often as the items last, so a step uses up at least one size ("ranks 40 to 90 of size 300 go, three
each, to containers 7 to 23"), and the number of steps does not grow with the number of items. Items find their run by size
and by their rank within the size; sizes that very many items share are ranked in hash buckets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKED_AT_ONCE = 200_000  # items of one size that one task ranks
MOST_RUNS = 1_000_000  # more run rows are joined by a shuffle; there are some 30,000 for capacities up to 8,192


class Packing:
    """Best-fit over ``{size: count}`` with the given permitted capacities, jointly."""

    def __init__(self, histogram: dict[int, int], capacities: list[int], overhead: int = 0):
        self.capacities, self.overhead = sorted(capacities), overhead
        self.left = {s: n for s, n in histogram.items() if s > 0}
        self.sizes = sorted(self.left)
        self.groups: list[tuple[int, int, int, int]] = []  # first container, how many, capacity, tokens in each
        self.runs: list[tuple[int, int, int, int, int, int, int]] = []  # as in ``assignments``
        self.total, self.rank = 0, defaultdict(int)
        while self.sizes:
            self._open()
        if histogram.get(0):
            self._place_empty(histogram[0])

    def _complete(self, capacity: int) -> tuple[list[tuple[int, int]], int]:
        """The contents ``[(size, items)]`` of one container of a capacity, and the room that stays: each time the largest item that fits."""
        contents, room, high = [], capacity, len(self.sizes)
        while room:
            high = bisect_right(self.sizes, room, 0, high) - 1
            if high < 0:
                break
            size = self.sizes[high]
            items = min(self.left[size], room // size)
            contents.append((size, items))
            room -= items * size
        return contents, room

    def _open(self) -> None:
        """Containers of the least cost per token for the largest item left, as many as the items of their contents last."""
        options = []
        for capacity in self.capacities[bisect_left(self.capacities, self.sizes[-1]) :]:
            contents, room = self._complete(capacity)
            filled = capacity - room
            final = self.capacities[bisect_left(self.capacities, filled)]
            options.append(((final + self.overhead) / filled, -final, filled, contents))
        _, final, filled, contents = min(options)
        times = min(self.left[size] // items for size, items in contents)
        self.groups.append((self.total, times, -final, filled))
        for size, items in contents:
            self.runs.append((size, self.rank[size], self.rank[size] + items * times, self.total, items, -final, filled))
            self.rank[size] += items * times
            self.left[size] -= items * times
            if not self.left[size]:
                del self.sizes[bisect_left(self.sizes, size)]
        self.total += times

    def _place_empty(self, count: int) -> None:
        """Empty items take no room; they are spread over the containers, or get one of the least capacity."""
        if not self.total:
            self.total = 1
            self.groups.append((0, 1, self.capacities[0], 0))
        each, rank = -(-count // self.total), 0
        for first, n, capacity, filled in self.groups:
            until = min(count, rank + n * each)
            if until > rank:
                self.runs.append((0, rank, until, first, each, capacity, filled))
            rank = until

    def assignments(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """``(size, from rank, until rank, first container, items in each, capacity, tokens in each)``."""
        return self.runs

    def space(self) -> int:
        """The final capacity of all containers together."""
        return sum(n * capacity for _, n, capacity, _ in self.groups)


def pack_each(items: DataFrame, packings: dict[str, list[int]], *, id_col: str = "doc_id", size_col: str = "n_tokens", overhead: int = 0) -> DataFrame:
    """``(packing, container_id, capacity_tokens, filled_tokens, id, piece_no, first_token, n_tokens)`` of several packings at once.

    Each packing has its permitted capacities and holds every item. An item is split only if it is larger than the largest
    capacity: into pieces of that capacity and a rest. Items of size 0 or null take no room and go to any container. The
    result is the same in every run: ranks go by id and piece. Repeated ids are items of their own, but must not be expected
    in a certain order.
    """
    spark = items.sparkSession
    capacities = {name: sorted({int(c) for c in some}) for name, some in packings.items()}
    size = F.coalesce(F.col(size_col), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("packing"), F.lit(some[-1]).alias("most")) for name, some in capacities.items()]))
    pieces = (
        items.select(F.col(id_col), size.alias("_size"), each.alias("_p"))
        .select(id_col, "_size", "_p.packing", F.col("_p.most").alias("_most"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / F.col("_most")) - 1, F.lit(0)).cast("int"))))
        .withColumn("first_token", F.col("piece_no").cast("long") * F.col("_most"))
        .withColumn("n_tokens", F.least(F.col("_size") - F.col("first_token"), F.col("_most")).cast("int"))
        .drop("_size", "_most")
    )
    # At most (largest capacity + 1) rows for each packing, whatever the number of items.
    counted = pieces.groupBy("packing", "n_tokens").count().collect()
    histograms: dict[str, dict[int, int]] = {name: {} for name in capacities}
    for name, n_tokens, count in counted:
        histograms[name][n_tokens] = count
    plans = {name: Packing(histograms[name], some, overhead) for name, some in capacities.items()}
    shape = "packing string, n_tokens int, _from long, _until long, _first long, _each long, capacity_tokens int, filled_tokens int"
    rows = [(name, *run) for name, plan in plans.items() for run in plan.assignments()]
    runs = spark.createDataFrame(rows, shape)
    placed = (
        _ranked(pieces, {(name, s): n for name, s, n in counted}, id_col)
        .join(F.broadcast(runs) if len(rows) <= MOST_RUNS else runs, ["packing", "n_tokens"])
        .where("_rank >= _from AND _rank < _until")
        .withColumn("container_id", F.col("_first") + F.expr("(_rank - _from) div _each"))
    )
    return placed.select("packing", "container_id", "capacity_tokens", "filled_tokens", id_col, "piece_no", "first_token", "n_tokens")


def _ranked(pieces: DataFrame, counts: dict[tuple[str, int], int], id_col: str, at_once: int | None = None) -> DataFrame:
    """Adds ``_rank``, the number of a piece within its packing and size. A size of many pieces is cut into hash buckets."""
    spark, at_once = pieces.sparkSession, at_once or RANKED_AT_ONCE
    hot = [(name, size, -(-n // at_once)) for (name, size), n in counts.items() if n > at_once]
    order = [id_col, "piece_no"]
    if not hot:
        return pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("packing", "n_tokens").orderBy(*order)) - 1)
    wide = F.broadcast(spark.createDataFrame(hot, "packing string, n_tokens int, _buckets int"))  # not more than sizes
    cut = pieces.join(wide, ["packing", "n_tokens"], "left").withColumn("_bucket", F.coalesce(F.pmod(F.xxhash64(*order), "_buckets"), F.lit(0)))
    sizes = cut.where("_buckets IS NOT NULL").groupBy("packing", "n_tokens", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("packing", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("packing", "n_tokens", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # a row for every RANKED_AT_ONCE pieces
    place = F.row_number().over(Window.partitionBy("packing", "n_tokens", "_bucket").orderBy(*order)) - 1
    return cut.withColumn("_place", place).join(before, ["packing", "n_tokens", "_bucket"], "left").withColumn("_rank", F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_place", "_before", "_bucket", "_buckets")


def pack(items: DataFrame, capacities: list[int], **how) -> DataFrame:
    """One packing, as ``pack_each`` without the column ``packing``."""
    return pack_each(items, {"only": capacities}, **how).drop("packing")
