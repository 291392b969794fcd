"""Penalised change points of many series, by dynamic programming with divide and conquer.

A series is the sum of a value for each day of a key, from its first to its last day with rows; days without any count
0. It is cut into segments of at least SHORTEST days so that the costs and a penalty for each cut are least. A segment of n
days with sum S and sum of squares Q has the spread V = 1 + floor((nQ - SS) / nn) and costs n * floor(1000 ln V), in
whole numbers; ln is that of doubles.

Let best(j) be the least cost of the first j days. The range of j is halved: the left half is solved, then what its
places offer to those of the right half is pushed there by a min-plus kernel, in blocks of places against places, and
then the right half is solved, its places having heard of all before them. Keys are (cost, segments) in one number,
and offers come with ascending starts and replace only greater keys: of equal ones the earliest start stays, so ties go to fewest segments,
then to the earliest start of the last segment, of the one before it, and so on.

Days are summed before the shuffle, so a frequent key or day sends a number for each task. A key's days are then read in
order, as a stream: memory is that of one series and a block, whatever the number of keys. Several series are
solved side by side. Time grows with the square of a series' days, from first to last; these are days of a calendar,
not rows.

Rows without day or value take no part; rows with a null key are one series of their own; repeated rows all count. A
series of less than SHORTEST days is one segment. Sums that might leave 64 bits are calculated in Python's integers, and given as the nearest number of 64 bits.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

PENALTY, SHORTEST = 10_000, 5
#: Numbers in a working array of the kernel; days of series that are solved side by side.
CELLS, DAYS = 1 << 19, 1 << 16
#: Places in a block of the kernel.
BLOCK = 256
RESULT = ("segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")

_whole_log = np.frompyfunc(lambda v: math.floor(1000 * math.log(v)), 1, 1)


def spread(n, total, squares):
    """1 + the floored variance, in whole numbers."""
    return 1 + (n * squares - total * total) // (n * n)


def cost(n, v):
    logs = _whole_log(v) if getattr(v, "dtype", None) == object else np.floor(1000 * np.log(v)).astype(np.int64)
    return n * logs


class Solver:
    """The least costs of series of at most n days, side by side; shorter ones are filled up with zeros, which come
    after all that counts for them."""

    def __init__(self, values: np.ndarray, penalty: int = PENALTY, shortest: int = SHORTEST):
        many, n = values.shape
        top = float(np.abs(values.astype(np.float64)).sum(axis=1).max(initial=0))
        kind = np.int64 if values.dtype != object and 4 * (n + 1) * top * top < 2.0**62 else object
        values = values.astype(kind)
        zero = np.zeros((many, 1), kind)
        self.sums = np.concatenate([zero, np.cumsum(values, axis=1)], axis=1)
        self.squares = np.concatenate([zero, np.cumsum(values * values, axis=1)], axis=1)
        self.penalty, self.shortest = penalty, shortest
        self.unit = n + 2  # keys are cost * unit + segments
        self.never = 1 << 62 if kind == np.int64 else 1 << 200
        self.keys = np.full((many, n + 1), self.never, kind)
        self.keys[:, 0] = 0
        self.start = np.full((many, n + 1), -1, np.int32)
        self._solve(0, n + 1)

    def _solve(self, low: int, high: int) -> None:
        if high - low <= self.shortest:  # no segment fits in between
            return
        middle = (low + high) // 2
        self._solve(low, middle)
        size = max(self.shortest, min(BLOCK, math.isqrt(CELLS // len(self.keys)) or 1))
        for j in range(middle, high, size):
            for i in range(low, middle, size):
                self._push(i, min(i + size, middle), j, min(j + size, high))
        self._solve(middle, high)

    def _push(self, low: int, middle: int, at: int, high: int) -> None:
        """What the places low to middle offer to at to high."""
        days = np.arange(at, high)[None, :] - np.arange(low, middle)[:, None]
        if days[0, -1] < self.shortest:
            return
        n = np.maximum(days, 1).astype(self.keys.dtype)
        part = lambda x: x[:, None, at:high] - x[:, low:middle, None]
        offers = cost(n, spread(n, part(self.sums), part(self.squares))) * self.unit + (self.penalty * self.unit + 1)
        if low == 0:
            offers[:, 0] -= self.penalty * self.unit
        before = self.keys[:, low:middle, None]
        offers = np.where((days >= self.shortest) & (before < self.never), before + offers, self.never)
        first = offers.argmin(axis=1)  # the earliest of equal ones
        best = np.take_along_axis(offers, first[:, None], axis=1)[:, 0]
        less = best < self.keys[:, at:high]
        self.keys[:, at:high] = np.where(less, best, self.keys[:, at:high])
        self.start[:, at:high] = np.where(less, first + low, self.start[:, at:high])

    def segments(self, row: int, n: int) -> list[int]:
        """The starts of the segments of a series of n days, and n."""
        out = [n]
        while n:
            n = int(self.start[row, n]) if n >= self.shortest else 0
            out.append(n)
        return out[::-1]

    def described(self, row: int, edges: list[int]) -> list[tuple[int, ...]]:
        """n_days, total, spread and cost of each segment."""
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            total, squares = int(self.sums[row, b] - self.sums[row, a]), int(self.squares[row, b] - self.squares[row, a])
            v = spread(b - a, total, squares)
            out.append((b - a, total, v, int(cost(b - a, np.array([v], self.keys.dtype))[0])))
        return out


def _long(x: int) -> int:
    return min(max(x, -(2**63)), 2**63 - 1)


def solved(days: np.ndarray, totals: np.ndarray, bounds: np.ndarray, penalty: int, shortest: int) -> tuple[np.ndarray, list[tuple]]:
    """The series days[bounds[i]:bounds[i + 1]] (ascending), cut: of which series each segment is, and the RESULT columns."""
    sizes = days[bounds[1:] - 1] - days[bounds[:-1]] + 1
    order = np.argsort(sizes, kind="stable")
    of, rows, at = [], [], 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * int(sizes[order[to]]) <= DAYS:
            to += 1
        group = order[at:to]
        values = np.zeros((len(group), int(sizes[group[-1]])), totals.dtype)
        for row, s in enumerate(group.tolist()):
            a, b = bounds[s], bounds[s + 1]
            values[row, days[a:b] - days[a]] = totals[a:b]
        solver = Solver(values, penalty, shortest)
        for row, s in enumerate(group.tolist()):
            edges = solver.segments(row, int(sizes[s]))
            parts = solver.described(row, edges)
            whole = sum(p[-1] for p in parts) + penalty * (len(parts) - 1)
            for number, (start, p) in enumerate(zip(edges, parts, strict=False), 1):
                of.append(s)
                rows.append((number, int(days[bounds[s]]) + start, *map(_long, p), len(parts), _long(whole)))
        at = to
    return np.array(of, np.int64), rows


def _same(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first equals the one before it; nulls do."""
    a, b = keys.slice(1), keys.slice(0, max(0, len(keys) - 1))
    equal = pc.fill_null(pc.equal(a, b), False)
    return np.array(pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))), bool)


def _streamed(batches: Iterator[pa.RecordBatch], key: str, penalty: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """Series from rows in order of key and day; the last one of a batch waits for the next batch."""
    kinds = [pa.int32(), *[pa.int64()] * 7]
    rest: list[pa.RecordBatch] = []

    def cut(whole: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        keys, days, totals = (whole.column(i).combine_chunks() for i in range(3))
        edges = np.concatenate([[0], np.flatnonzero(~_same(keys)) + 1, [len(keys)] if last else []]).astype(np.int64)
        if len(edges) > 1:
            of, rows = solved(np.array(days)[: edges[-1]], np.array(totals)[: edges[-1]], edges, penalty, shortest)
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(edges[of[at : at + 10_000]])), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[key, *RESULT])
        rest[:] = whole.slice(int(edges[-1])).to_batches() if not last else []

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        # a series that fills many batches is put together once it has ended
        if len(rest) == 1 or not _same(pa.concat_arrays([rest[0].column(0).slice(0, 1), batch.column(0).slice(batch.num_rows - 1, 1)]))[0]:
            yield from cut(pa.Table.from_batches(rest), False)
    if rest:
        yield from cut(pa.Table.from_batches(rest), True)


def segments(rows: DataFrame, key: str, time: str | Column, value: str, penalty: int = PENALTY, shortest: int = SHORTEST) -> DataFrame:
    """key and the RESULT columns: the segments of each key's daily sums of a whole-number value."""
    day = F.unix_date(F.to_date(time)).cast("bigint")
    known = rows.select(F.col(key).alias("__key"), day.alias("__day"), F.col(value).cast("bigint").alias("__value")).where("__day is not null and __value is not null")
    daily = known.groupBy("__key", "__day").agg(F.sum("__value").alias("__total"))
    ordered = daily.repartition("__key").sortWithinPartitions("__key", "__day")
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("segment_no", IntegerType()), *[StructField(x, LongType()) for x in RESULT[1:]]])
    return ordered.mapInArrow(lambda b: _streamed(b, key, penalty, shortest), schema)
