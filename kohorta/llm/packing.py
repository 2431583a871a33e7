"""Packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths, at most one row for each length, decides. A configuration says how many
pieces of each length share a sequence; the program asks for as few configurations as cover the histogram.
Multiplicative weights come first: lengths not yet covered weigh more, a knapsack dynamic program over the capacity finds
the configuration of the largest weight, and its weight bounds the optimum from below. The solution is scaled
so that no length is covered twice, rounded down, and all that is left is put together by best fit on the histogram; with
thousands of lengths that is most of it. If the result is not within TOLERANCE of the bound, the program is solved by
column generation until its own bound is met within TOLERANCE, over the lengths or, if they are many, over CLASSES of them
rounded up to their longest; it is rounded down, what is left (bounded by the number of classes, not by the data) goes to
best fit, the prices of the classes give another lower bound, and the better plan is taken. Pieces take their places by their number among the pieces of their
length, so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorta.llm.text import filled, narrow, slices, stage
from kohorta.llm.tokens import encoder

ROUNDS, STEEPNESS = 200, 4.0
CLASSES, TOLERANCE = 150, 1e-3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, place long"


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The configuration of the largest value: how often each length (by index) is taken."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], n = best[room - 1], fitting[room]
        if n:
            reached = best[room - lengths[:n]] + values[:n]
            at = int(reached.argmax())
            if reached[at] > best[room]:
                best[room], taken[room] = reached[at], at
    chosen: dict[int, int] = {}
    room = capacity
    while room:
        at = int(taken[room])
        if at < 0:
            room -= 1
        else:
            chosen[at] = chosen.get(at, 0) + 1
            room -= int(lengths[at])
    return float(best[capacity]), chosen


def best_fit(lengths, counts, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations of all pieces, filled with the longest that fit; ``lengths`` are sorted."""
    plan = []
    alive = [int(x) for x in lengths[counts > 0]]
    stock = {int(x): int(n) for x, n in zip(lengths, counts) if n}
    while alive:
        room, chosen = capacity, {}
        while (at := bisect_right(alive, room)) > 0:
            size = alive[at - 1]
            while at > 0 and chosen.get(size, 0) >= stock[size]:
                at -= 1
                size = alive[at - 1] if at else 0
            if not at:
                break
            chosen[size] = chosen.get(size, 0) + min(stock[size] - chosen.get(size, 0), room // size)
            room = capacity - sum(k * n for k, n in chosen.items())
        times = min(stock[k] // n for k, n in chosen.items())
        plan.append((chosen, times))
        for k, n in chosen.items():
            stock[k] -= times * n
            if not stock[k]:
                del stock[k]
                alive.pop(bisect_right(alive, k) - 1)
    return plan


def column_generation(lengths, counts, capacity: int) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """The configuration program solved by the simplex method with knapsack pricing, and the price of each length.

    It ends when the bound from the prices, objective / value of the best configuration, is within half the tolerance.
    """
    n = len(lengths)
    columns = np.diag(capacity // lengths).astype(float)
    wanted = counts * (1 + 1e-7 * np.random.default_rng(0).random(n))  # no ties between rows, so no cycles
    while True:
        inverse = np.linalg.inv(columns)
        often, prices = inverse @ wanted, inverse.sum(axis=0)
        value, chosen = knapsack(lengths, prices, capacity)
        if value <= 1 + TOLERANCE / 2:
            break
        column = np.zeros(n)
        column[[*chosen]] = [*chosen.values()]
        change = inverse @ column
        rising = change > 1e-9
        ratio = np.full(n, np.inf)
        ratio[rising] = np.maximum(often[rising], 0) / change[rising]
        columns[:, int(ratio.argmin())] = column
    return [({int(i): int(c[i]) for i in np.flatnonzero(c)}, float(x)) for c, x in zip(columns.T, often)], prices


def by_classes(lengths, counts, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(plan, lower bound) by column generation over at most CLASSES of the sorted lengths, of about equal tokens."""
    own = np.arange(len(lengths))
    if len(lengths) > CLASSES:
        tokens = np.cumsum(lengths * counts)
        own = np.unique((tokens - 1) * CLASSES // tokens[-1], return_inverse=True)[1]
    tops = np.array([lengths[own == c].max() for c in range(own[-1] + 1)])
    solution, prices = column_generation(tops, np.bincount(own, counts), capacity)
    prices = np.maximum.accumulate(np.maximum(prices, 0))
    below = np.append(0.0, prices)[np.searchsorted(tops, lengths, side="right")]
    bound = max(int(np.ceil(counts @ v / knapsack(lengths, v, capacity)[0] - 1e-6))
                for v in (np.interp(lengths, tops, prices), below, prices[own]) if v.any())
    left, plan = counts.copy(), []
    members = [np.flatnonzero(own == c).tolist() for c in range(len(tops))]
    for config, often in sorted(solution, key=lambda s: -s[1]):
        times = int(often + 1e-6)
        while times:
            taken: dict[int, int] = {}
            for c, n in config.items():
                for i in reversed(members[c]):
                    if n and left[i]:
                        taken[i] = min(n, int(left[i]))
                        n -= taken[i]
            if not taken:
                break
            step = min(times, *(int(left[i]) // n for i, n in taken.items()))
            for i, n in taken.items():
                left[i] -= step * n
            plan.append(({int(lengths[i]): n for i, n in taken.items()}, step))
            times -= step
    return plan + best_fit(lengths, left, capacity), bound


def configurations(lengths, counts, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int]:
    """([({length: pieces of it in a sequence}, number of such sequences)], lower bound on the sequences)."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(lengths):
        return [], 0
    covered, bound, solution = np.zeros(len(lengths)), -(-int(lengths @ counts) // capacity), []
    for _ in range(rounds):
        values = lengths * np.exp(-STEEPNESS * covered) / capacity
        value, chosen = knapsack(lengths, values, capacity)
        bound = max(bound, int(np.ceil(counts @ values / value - 1e-6)))
        at, often = np.array([*chosen]), np.array([*chosen.values()])
        step = (counts[at] / often).min()
        solution.append((at, often, step))
        covered[at] += step * often / counts[at]
        if covered.min() >= 1:
            break
    scale, left, plan = max(1.0, covered.max()), counts.copy(), []
    for at, often, step in solution:
        times = int(min(step / scale, (left[at] // often).min()))
        if times:
            left[at] -= times * often
            plan.append(({int(lengths[i]): int(n) for i, n in zip(at, often)}, times))
    plan += best_fit(lengths, left, capacity)
    if sum(n for _, n in plan) > bound * (1 + TOLERANCE) + 1:
        other, found = by_classes(lengths, counts, capacity)
        plan, bound = min(plan, other, key=lambda p: sum(n for _, n in p)), max(bound, found)
    return plan, bound


def _places(plan):
    """For each length, from which number on which configuration takes its pieces."""
    used, rows, sequence = {}, [], 0
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            rows.append((length, used.get(length, 0), config[length], sequence, offset))
            used[length] = used.get(length, 0) + times * config[length]
            offset += length * config[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _cut(tokenizer, chunks, end_id, capacity):
    def run(batches):
        encode, shard = encoder(tokenizer, chunks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(filled(batch.column("text")).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start: 4 * (start + capacity)]
                    n = len(part) // 4
                    rows.append((doc, piece, start, n, zlib.crc32(part), shard, int(seen[n])))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             [c.split()[0] for c in PIECES.split(", ")])
    return run


def _place(table):
    keys = (table[:, 0] << 42) | table[:, 1]

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 42) | number, side="right") - 1
            _, first, often, sequence, offset = table[at].T
            own = number - first
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(sequence + own // often), pa.array(offset + own % often * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_sequences(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", chunks: str = "dropped", end_id: int = 1,
                   capacity: int = 4096, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece of each document (doc_id, text) with its sequence and the offset in it.

    A document is its token ids and ``end_id``; one of more than ``capacity`` ids is cut into pieces of that size. A missing
    or empty text is its end id alone; missing and repeated doc_ids are packed like others; an empty table gives an
    empty result.
    """
    docs = narrow(documents, doc_id="bigint", text="string")
    pieces = stage(docs.mapInArrow(_cut(tokenizer, chunks, end_id, capacity), PIECES), "pieces")
    by_shard = stage(pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "histogram")
    histogram = by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan, _ = configurations([r.length for r in histogram], [r.n for r in histogram], capacity, rounds)
    table, _ = _places(plan)
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = by_shard.select("shard", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["shard", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("number"))
    return numbered.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                              "sequence_id long, offset long")
