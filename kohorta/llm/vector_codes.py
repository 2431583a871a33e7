"""Vector codes by a codebook per part, with anchors-hierarchy metric trees.

Vectors are cut into equal parts and every part position has its own small codebook. Each task builds, over blocks of vectors,
one metric tree per part position, middle-out: anchors are placed at the farthest points and steal the points that are
nearer to them, the anchors' balls are merged in pairs up to one root, and large anchors are split in the same way below. A ball
caches its number of points and their sum, and its points stand side by side. The trees are written once. A round walks
them from the roots: a ball inherits the entries that may own a point of it, drops those that another entry beats
everywhere in the ball, and once a single entry is left gives it the cached sum and count; only leaves that stay contested look
at points. Sums are integers, so the rounds are exact; what reaches the driver is one sum per entry and component.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import picked, stage
from kohorta.session import checked_broadcast, scratch_path

BLOCK, LEAF = 1024, 32
#: Scaled components are held to this size: beyond it no error fits a long.
LARGEST = 1 << 40
#: Relative room for rounding in the bound; larger only means that fewer entries are dropped.
ROOM = 1e-9
WIDE = pa.decimal128(38, 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis; through Python integers where 64 bits may not hold them."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * most * most * max(a.shape[-1], 1) >= 1 << 62:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(axis=-1)


def _distance(a, b):
    return np.sqrt(squares(a, b).astype(float))


def anchors(points: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """The members dealt to about the square root of their number of anchors; fewer if they have fewer values."""
    own = points[members]
    places, owner, far = [0], np.zeros(len(members), np.int64), _distance(own, own[0])
    for _ in range(1, max(2, round(len(members) ** 0.5))):
        fresh = int(far.argmax())  # the farthest point of the ball with the largest radius
        if far[fresh] == 0:
            break
        to_anchor = _distance(own[places], own[fresh])
        near = np.flatnonzero(far * 2 > to_anchor[owner])  # no other point can be nearer to the new anchor
        gap = _distance(own[near], own[fresh])
        stolen = near[gap < far[near]]
        far[near] = np.minimum(far[near], gap)
        owner[stolen] = len(places)
        places.append(fresh)
    return [members[owner == a] for a in range(len(places))]


def merges(points: np.ndarray, groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of balls to merge, each time the two with the smallest common ball; the n-th pair makes ball len(groups) + n."""
    k = len(groups)
    centre = np.array([points[g].mean(axis=0) for g in groups], float).reshape(k, -1)
    size = np.array([len(g) for g in groups], float)
    radius = np.array([np.sqrt(((points[g] - c).astype(float) ** 2).sum(axis=1)).max() for g, c in zip(groups, centre)])
    number = np.arange(k)

    def common(i):
        apart = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        share = size / (size + size[i])
        out = np.maximum(share * apart + radius[i], (1 - share) * apart + radius)
        out[(number < 0) | (np.arange(k) == i)] = np.inf
        return out
    table, out = np.array([common(i) for i in range(k)]), []
    for _ in range(k - 1):
        i, j = divmod(int(table.argmin()), k)
        out.append((int(number[i]), int(number[j])))
        radius[i], total = table[i, j], size[i] + size[j]
        centre[i], size[i] = (centre[i] * size[i] + centre[j] * size[j]) / total, total
        number[i], number[j] = k + len(out) - 1, -1
        table[j], table[:, j] = np.inf, np.inf
        table[i] = table[:, i] = common(i)
    return out


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points' order and the balls (start, end, left, right) over it; ball 0 is the root, leaves have children -1."""
    order, balls = np.zeros(len(points), np.int32), [[0, len(points), -1, -1]]
    open_ = [(0, np.arange(len(points)))]
    while open_:
        ball, members = open_.pop()
        groups = anchors(points, members) if len(members) > LEAF else [members]
        if len(groups) == 1:
            order[balls[ball][0]: balls[ball][1]] = members
            continue
        pairs = merges(points, groups)
        sizes = [len(g) for g in groups]
        for a, b in pairs:
            sizes.append(sizes[a] + sizes[b])
        below = [(ball, len(sizes) - 1)]
        while below:
            at, group = below.pop()
            if group < len(groups):
                open_.append((at, groups[group]))
                continue
            start, (a, b) = balls[at][0], pairs[group - len(groups)]
            for side, child in ((2, a), (3, b)):
                balls[at][side] = len(balls)
                below.append((len(balls), child))
                balls.append([start, start + sizes[child], -1, -1])
                start += sizes[child]
    return order, np.array(balls, np.int32)


@dataclass
class Block:
    """The trees of all part positions of some vectors, one behind the other."""
    count: int
    points: np.ndarray  # parts * count rows in tree order
    order: np.ndarray  # the vector of each of them
    balls: np.ndarray
    sums: np.ndarray
    radii: np.ndarray  # squared, from the floored centre, rounded up
    roots: np.ndarray

    @property
    def pivots(self):
        return self.sums // (self.balls[:, 1] - self.balls[:, 0])[:, None]


def build_block(vectors: np.ndarray, parts: int) -> Block:
    """Integer vectors (rows, parts * width) as trees."""
    m, width = len(vectors), vectors.shape[1] // parts
    orders, balls, points, roots = [], [], [], []
    for p in range(parts):
        own = vectors[:, p * width: (p + 1) * width]
        order, tree = build_tree(own)
        before = sum(map(len, balls))
        roots.append(before)
        shift = np.array([p * m, p * m, before, before])
        balls.append(np.where(tree < 0, -1, tree + shift))
        orders.append(order)
        points.append(own[order])
    points, balls = np.concatenate(points), np.concatenate(balls)
    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points, axis=0)])
    sums = running[balls[:, 1]] - running[balls[:, 0]]
    out = Block(m, points, np.concatenate(orders), balls, sums, np.zeros(len(balls)), np.array(roots))
    for i, ((start, end), pivot) in enumerate(zip(balls[:, :2], out.pivots)):
        out.radii[i] = float(squares(points[start:end], pivot).max())
    out.radii *= 1 + ROOM
    return out


def owners(block: Block, codebooks: np.ndarray):
    """Who owns what: balls wholly owned with their entry, and places of single points with theirs.

    ``codebooks`` is (part, entry, component). Ties go to the lower entry. The last value counts the distances computed.
    """
    parts, size, width = codebooks.shape
    between = squares(codebooks[:, :, None], codebooks[:, None]).astype(float) ** 0.5
    # an entry equal to an earlier one never wins
    first = ~np.array([[bool((b[:e] == b[e]).all(axis=1).any()) for e in range(size)] for b in codebooks])
    whole, single, products = [], [], 0
    front, may = block.roots, first
    pivots = block.pivots
    while len(front):
        part = block.balls[front, 0] // block.count
        gap = squares(pivots[front][:, None], codebooks[part])
        products += int(may.sum())
        masked = np.where(may, gap, int(gap.max(initial=0)) + 1)
        best = masked.argmin(axis=1)
        least = masked[np.arange(len(front)), best].astype(float)[:, None]
        reach = 2 * np.sqrt(block.radii[front])[:, None] * between[part, best]
        may = may & (gap.astype(float) - least <= reach * (1 + ROOM) + ROOM * least)
        may[block.radii[front] == 0] = False  # equal points
        may[np.arange(len(front)), best] = True
        owned = may.sum(axis=1) == 1
        whole.append((front[owned], best[owned]))
        left, right = block.balls[front, 2], block.balls[front, 3]
        leaf = ~owned & (left < 0)
        if leaf.any():
            start, end = block.balls[front[leaf], 0], block.balls[front[leaf], 1]
            of = np.repeat(np.arange(len(start)), end - start)
            place = np.arange(len(of)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[of]
            gap = squares(block.points[place][:, None], codebooks[part[leaf][of]])
            allowed = may[leaf][of]
            products += int(allowed.sum())
            single.append((place, np.where(allowed, gap, int(gap.max(initial=0)) + 1).argmin(axis=1)))
        deeper = ~owned & (left >= 0)
        front = np.concatenate([left[deeper], right[deeper]])
        may = np.concatenate([may[deeper], may[deeper]])
    joined = [[np.concatenate([np.zeros(0, np.int64), *[x[i] for x in found]]).astype(np.int64) for i in (0, 1)]
              for found in (whole, single)]
    return *joined[0], *joined[1], products


def owned_sums(block: Block, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (part, entry, component) and counts (part, entry) of the points that every entry owns."""
    parts, size, width = codebooks.shape
    sums, counts = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
    balls, entry, places, nearest, _ = owners(block, codebooks)
    start, end = block.balls[balls, 0], block.balls[balls, 1]
    cell = start // block.count * size + entry
    np.add.at(sums, cell, block.sums[balls])
    np.add.at(counts, cell, end - start)
    cell = places // block.count * size + nearest
    np.add.at(sums, cell, block.points[places])
    np.add.at(counts, cell, 1)
    return sums.reshape(codebooks.shape), counts.reshape(parts, size)


def codes_of(block: Block, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part (vector, part), and the squared distances summed over the parts."""
    parts = len(codebooks)
    balls, entry, places, nearest, _ = owners(block, codebooks)
    chosen = np.zeros(len(block.points), np.int64)
    for (start, end), e in zip(block.balls[balls, :2], entry):
        chosen[start:end] = e
    chosen[places] = nearest
    part = np.repeat(np.arange(parts), block.count)
    gap = squares(block.points, codebooks[part, chosen])
    codes, errors = np.zeros((block.count, parts), np.int64), np.zeros((block.count, parts), gap.dtype)
    codes[block.order, part], errors[block.order, part] = chosen, gap
    return codes, errors.sum(axis=1)


def _rows(lists, width, scale):
    """Vectors as rows of floor(scale * x), shorter ones filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(values * scale), -LARGEST, LARGEST)
    return out


def _packed(blocks):
    narrow = [next(k for k in ("<i2", "<i4", "<i8") if abs(b.points).max(initial=0) <= np.iinfo(k).max) for b in blocks]
    return [pa.array(narrow), *[pa.array([x.tobytes() for x in column], pa.binary()) for column in (
        [b.points.astype(k) for b, k in zip(blocks, narrow)], [b.order.astype("<i4") for b in blocks],
        [b.balls.astype("<i4") for b in blocks], [b.sums.astype("<i8") for b in blocks],
        [b.radii.astype("<f8") for b in blocks], [b.roots.astype("<i4") for b in blocks])]]


PACKED = ["kind", "points", "trees", "balls", "sums", "radii", "roots"]
TREES = ", ".join(f"{c} {'string' if c == 'kind' else 'binary'}" for c in PACKED)


def _grow(parts, width, scale):
    def made(rows):
        block = build_block(_rows(rows.column("vector"), parts * width, scale), parts)
        offsets = pa.array([0, rows.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, *_packed([block])], ["ids", "labels", *PACKED])

    def run(batches):
        waiting = None
        for batch in chain(batches, [None]):
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                waiting = fresh if waiting is None else pa.concat_tables([waiting, fresh])
            while waiting is not None and waiting.num_rows >= (BLOCK if batch is not None else 1):
                yield made(waiting.slice(0, BLOCK).combine_chunks().to_batches()[0])
                waiting = waiting.slice(BLOCK)
    return run


def _blocks(batch, width):
    columns = [batch.column(c).to_pylist() for c in PACKED]
    for kind, points, order, balls, sums, radii, roots in zip(*columns):
        order = np.frombuffer(order, "<i4")
        roots = np.frombuffer(roots, "<i4")
        points = np.frombuffer(points, kind).astype(np.int64).reshape(len(order), width)
        yield Block(len(order) // len(roots), points, order, np.frombuffer(balls, "<i4").reshape(-1, 4),
                    np.frombuffer(sums, "<i8").reshape(-1, width), np.frombuffer(radii, "<f8"), roots)


def _round(codebooks):
    def run(batches):
        sums, counts, any_ = np.zeros(codebooks.shape, object), np.zeros(codebooks.shape[:2], np.int64), False
        for batch in batches:
            for block in _blocks(batch, codebooks.shape[2]):
                more, n = owned_sums(block, codebooks)
                sums, counts, any_ = sums + more, counts + n, True
        if any_:
            table = np.concatenate([sums, counts[:, :, None]], axis=2).astype(object).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table), dtype=np.int32)),
                                              pa.array([Decimal(int(x)) for x in table], WIDE)], ["cell", "total"])
    return run


def _assign(codebooks):
    def run(batches):
        for batch in batches:
            ids, labels = batch.column("ids"), batch.column("labels")
            for i, block in enumerate(_blocks(batch, codebooks.shape[2])):
                codes, errors = codes_of(block, codebooks)
                offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, labels[i].values,
                     pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32))),
                     pa.array([Decimal(int(x)) for x in errors], WIDE)], ["vec_id", "label", "codes", "wide"])
    return run


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
    """Codes and codebooks of ``vectors`` (vec_id, embedding, label): two tables.

    The first has a row per kept row: vec_id, label, codes (entry of every part), error (squared distances summed over the parts)
    and label_error (error summed over the rows of an equal label, missing labels together); the second has part, entry and
    components. Components become floor(scale * x), held to 2^40 in size; an error or sum that no long holds is missing.
    Codebooks start from the ``entries`` smallest vec_ids in ascending order (repeated ones count once, with
    their smallest vector, rows without vec_id come last; fewer ids make shorter codebooks), take ``rounds`` rounds of assignment and floored means, unused entries stay, and all
    rows are assigned once more; ties go to the lower entry. Rows whose embedding is missing or holds a missing or non-finite
    component are dropped, repeated rows count each, shorter (also empty) vectors count as filled with zeros up to the longest one's
    width, itself filled up to a multiple of ``parts``; other columns are left out, whatever their names. An
    empty table gives two empty tables.
    """
    spark = vectors.sparkSession
    rows = picked(vectors, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    kept = rows.where(F.col("vector").isNotNull() & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    kind = rows.schema["label"].dataType.simpleString()
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return (spark.createDataFrame([], f"vec_id long, label {kind}, codes array<int>, error long, label_error long"),
                spark.createDataFrame([], "part int, entry int, components array<long>"))
    width = max(1, -(-longest // parts))
    smallest = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    chosen = F.col("vec_id").isin([i for i in smallest if i is not None])
    chosen = chosen | F.col("vec_id").isNull() if None in smallest else chosen
    scaled = F.transform("vector", lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST)), F.lit(-LARGEST)))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(parts * width) - F.size("vector"))
    start = kept.where(chosen).groupBy("vec_id").agg(F.min(F.concat(scaled, zeros)).alias("vector")).orderBy(
        F.col("vec_id").asc_nulls_last()).collect()
    books = np.array([r["vector"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    path = scratch_path(spark, "metric-trees")
    grown = kept.mapInArrow(_grow(parts, width, scale), f"ids array<bigint>, labels array<{kind}>, {TREES}")
    grown.write.option("parquet.block.size", 16 << 20).parquet(path)
    trees = spark.read.schema(grown.schema).parquet(path)
    for _ in range(rounds):
        found = trees.select(*PACKED).mapInArrow(_round(books), "cell int, total decimal(38,0)").groupBy("cell").agg(
            F.sum("total").alias("total")).collect()
        table = np.zeros(parts * len(start) * (width + 1), object)
        for cell, total in found:
            table[cell] = int(total)
        table = table.reshape(parts, len(start), width + 1)
        count = table[:, :, width:]
        books = np.where(count > 0, table[:, :, :width] // np.maximum(count, 1), books).astype(np.int64)
    coded = trees.mapInArrow(_assign(books), f"vec_id bigint, label {kind}, codes array<int>, wide decimal(38,0)")
    coded = stage(coded, "vector-codes")
    totals = stage(coded.groupBy("label").agg(F.sum("wide").alias("sum")), "label-errors").withColumnRenamed("label", "of")
    result = coded.join(checked_broadcast(totals), F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "label", "codes", F.col("wide").try_cast("bigint").alias("error"),
        F.col("sum").try_cast("bigint").alias("label_error"))
    book_rows = [(p, e, [int(x) for x in books[p, e]]) for p in range(parts) for e in range(len(start))]
    return result, spark.createDataFrame(book_rows, "part int, entry int, components array<long>")
