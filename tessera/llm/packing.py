"""Packing documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of at most
``capacity`` counts holds all that the plan depends on, whatever the corpus:

1. Large lengths (over a fraction of the capacity) are sorted and dealt into
   ``GROUPS`` groups of equal cardinality; each is rounded up to its group's largest.
2. The few sizes left are packed by configurations: a linear programme over
   multisets of sizes that fit a sequence, solved by column generation with a
   knapsack as its pricing, its solution rounded down.
3. The actual lengths take the places of the rounded ones, which leaves room.
4. What remains (the rounding's rest and all small lengths) goes best fit,
   longest first.

Sequences with the same contents so far are one run with a count, so steps 3
and 4 cost by distinct lengths, not by documents.  Where "large" begins decides
how much is left to fill the room of step 3, so the plan is made for each
fraction in ``FRACTIONS`` and the one with the fewest sequences is used.  The plan is a list of
intervals: ranks ``[rank, rank + n)`` of a length go to these sequences at
these offsets.  On the cluster each piece needs only its rank among the pieces
of its length.  Ranks are dealt in buckets, so that a length that a third of
all pieces share is numbered by many tasks.

Edge cases: a null text is an empty one, one id long; a document longer than
the capacity is cut, the first piece taking what is left over; repeated rows
are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import cut, partitions, table

CAPACITY = 2048
SEPARATOR = 0
#: Lengths over capacity / fraction are large.
FRACTIONS = (2, 3, 4, 8)
GROUPS = 64
#: The linear programme stops where no configuration's value is over 1 + GAP.
GAP = 2e-4


@dataclass
class Plan:
    """Intervals by length: (rank, bins, copies, sequence, offset) for bins * copies ranks."""

    capacity: int
    n_sequences: int = 0
    intervals: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def place(self, length: int, bins: int, copies: int, sequence: int, offset: int) -> None:
        self.intervals[length].append((self.used[length], copies, sequence, offset))
        self.used[length] += bins * copies

    def arrays(self) -> dict[str, np.ndarray]:
        rows = [(length, *x) for length in sorted(self.intervals) for x in self.intervals[length]]
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        return dict(zip(("length", "rank", "copies", "sequence", "offset"), columns, strict=True))


def grouped(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Deal (length, count), longest first, into groups of equal cardinality: (size, [[length, count], ...])."""
    total = sum(n for _, n in large)
    out: list[tuple[int, list[list[int]]]] = []
    done = 0
    for length, n in large:
        while n:
            k = done * groups // total
            room = -(-(k + 1) * total // groups) - done
            take = min(n, room)
            if out and (out[-1][0] == length or k == last):
                out[-1][1].append([length, take])
            else:
                out.append((length, [[length, take]]))
            last, done, n = k, done + take, n - take
    return out


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity whose values sum highest."""
    use = np.flatnonzero(values > 1e-9)
    chosen = np.zeros(len(values), np.int64)
    if not len(use):
        return 0.0, chosen
    v, s = values[use], sizes[use]
    at = np.arange(capacity + 1)[None, :] - s[:, None]
    fits = at >= 0
    at = np.where(fits, at, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(s.min())):
        offer = np.where(fits, best[at] + v[:, None], -1.0)
        pick = offer.argmax(0)
        new = offer[pick, np.arange(capacity + 1)]
        better = new > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, new, best)
    left = capacity
    for pick in reversed(picks):
        if pick[left] >= 0:
            chosen[use[pick[left]]] += 1
            left -= int(s[pick[left]])
    return float(best[capacity]), chosen


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often each is used: the linear programme, rounded down.

    Revised simplex from one-size configurations; a surplus column enters where
    a size's price is below zero.
    """
    k = len(sizes)
    columns = [np.bincount([i], minlength=k) * (capacity // int(sizes[i])) for i in range(k)]
    cost = np.ones(k)
    inverse = np.diag(1.0 / np.array([c.max() for c in columns]))
    x = inverse @ demand
    for _ in range(60 * k):
        price = cost @ inverse
        if price.min() < -1e-9:
            i = int(price.argmin())
            column, c = -np.bincount([i], minlength=k), 0.0
        else:
            value, column = best_configuration(price, sizes, capacity)
            c = 1.0
            if value <= 1 + GAP:
                break
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[out], cost[out] = column, c
    return [(columns[i], int(x[i] + 1e-6)) for i in range(k) if cost[i] and x[i] + 1e-6 >= 1]


def substitute(plan: Plan, groups: list[tuple[int, list[list[int]]]], capacity: int) -> list[tuple[int, int, int]]:
    """Fill the configurations with actual lengths; runs of equal sequences as (room, first, count)."""
    sizes = np.array([size for size, _ in groups])
    demand = np.array([sum(n for _, n in rest) for _, rest in groups], float)
    runs: list[tuple[int, int, int]] = []
    for column, times in configurations(sizes, demand, capacity):
        # Sequences of this configuration, split where a slot's actual length changes.
        parts = [(plan.n_sequences, times, 0)]
        plan.n_sequences += times
        for g in np.flatnonzero(column):
            rest = groups[g][1]
            for _ in range(int(column[g])):
                parts = _fill_slot(plan, parts, rest)
        runs += [(capacity - fill, first, n) for first, n, fill in parts]
    return runs


def _fill_slot(plan: Plan, parts: list[tuple[int, int, int]], rest: list[list[int]]) -> list[tuple[int, int, int]]:
    out = []
    for first, n, fill in parts:
        while n:
            if not rest:
                out.append((first, n, fill))
                break
            length, there = rest[0]
            take = min(n, there)
            plan.place(length, take, 1, first, fill)
            out.append((first, take, fill + length))
            first, n = first + take, n - take
            rest[0][1] -= take
            if not rest[0][1]:
                rest.pop(0)
    return out


def best_fit(plan: Plan, runs: list[tuple[int, int, int]], items: list[tuple[int, int]], capacity: int) -> None:
    """Put (length, count), longest first, where they leave least room, else in new sequences."""
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for room, first, n in runs:
        open_runs[room].append((first, n))
    rooms = sorted(open_runs)

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_runs[room]:
                insort(rooms, room)
            open_runs[room].append((first, n))

    for length, count in items:
        while count:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(i)
            else:
                room, first, n = capacity, plan.n_sequences, -(-count // (capacity // length))
                plan.n_sequences += n
            # A sequence that took one stays the tightest while another fits.
            copies = min(room // length, count)
            bins = min(n, count // copies)
            plan.place(length, bins, copies, first, capacity - room)
            give(room - copies * length, first, bins)
            give(room, first + bins, n - bins)
            count -= bins * copies


def group_and_fit(histogram: dict[int, int], capacity: int, groups: int, fraction: int) -> Plan:
    """The four steps with lengths over capacity / fraction as the large ones."""
    plan = Plan(capacity)
    lengths = [(length, n) for length, n in sorted(histogram.items(), reverse=True) if n]
    large = [x for x in lengths if x[0] * fraction > capacity]
    dealt = grouped(large, min(groups, len(large))) if large else []
    runs = substitute(plan, dealt, capacity) if dealt else []
    rest: dict[int, int] = defaultdict(int)
    for _, left in dealt:
        for length, n in left:
            rest[length] += n
    best_fit(plan, runs, sorted(rest.items(), reverse=True) + lengths[len(large) :], capacity)
    return plan


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Where every rank of every length goes.  ``histogram``: pieces by length."""
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best = None
    for fraction in FRACTIONS:
        plan = group_and_fit(histogram, capacity, groups, fraction)
        if best is None or plan.n_sequences < best.n_sequences:
            best = plan
        if best.n_sequences <= least:
            break
    return best


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(capacity: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder()
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.encode(enc, text.as_py() or ""), np.uint32(SEPARATOR)).astype("<u4", copy=False)
                start, end = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    for column, value in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(ids[start:end])), strict=True):
                        column.append(value)
                    start, end, piece = end, end + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut_up


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row of ``docs``, each of at most ``capacity`` ids."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(capacity), PIECES)


def _places(arrays: dict[str, np.ndarray]):
    def places(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, rank = length.to_numpy(), rank.to_numpy()
        # Intervals are by length and rank; the last one that doesn't start after the piece holds it.
        low = np.searchsorted(arrays["length"], size)
        wide = int(arrays["rank"].max(initial=0)) + 1
        if wide < (1 << 62) // CAPACITY // 2:
            at = np.searchsorted(arrays["length"] * wide + arrays["rank"], size * wide + np.minimum(rank, wide - 1), side="right") - 1
        else:  # ranks so large that the two don't share 64 bits
            at = np.array([a + np.searchsorted(arrays["rank"][a : np.searchsorted(arrays["length"], s, side="right")], r, side="right") - 1 for a, s, r in zip(low, size, rank, strict=True)], np.int64)
        i, copies = rank - arrays["rank"][at], arrays["copies"][at]
        return pa.StructArray.from_arrays([pa.array(arrays["sequence"][at] + i // copies), pa.array(arrays["offset"][at] + i % copies * size)], names=["sequence_id", "offset"])

    return places


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Lengths with more pieces than a task should number are dealt in buckets; there are at most capacity + 4 * partitions.
    share = max(64, sum(histogram.values()) // (4 * partitions(spark)))
    hot = [(length, -(-n // share)) for length, n in sorted(histogram.items()) if n > share]
    buckets = F.broadcast(spark.createDataFrame(hot, "length long, buckets long"))
    dealt = pieces.join(buckets, "length", "left").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("buckets", F.lit(1))))
    starts: list[tuple[int, int, int]] = []
    if hot:
        sizes = dealt.filter("buckets is not null").groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()
        done: dict[int, int] = defaultdict(int)
        for length, bucket, n in sorted(map(tuple, sizes)):
            starts.append((length, bucket, done[length]))
            done[length] += n
    dealt = dealt.join(F.broadcast(spark.createDataFrame(starts, "length long, bucket long, first long")), ["length", "bucket"], "left")
    window = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(window) - 1 + F.coalesce("first", F.lit(0)))
    place = F.arrow_udf(_places(plan_packing(histogram, capacity, groups).arrays()), "struct<sequence_id:long,offset:long>")
    out = ranked.withColumn("at", place(F.col("length"), F.col("rank").cast("long")))
    return out.select(*pieces.columns, "at.sequence_id", "at.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_pieces(cut(token_pieces(docs, capacity), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
