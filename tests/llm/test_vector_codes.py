import math

import numpy as np
import pytest

from kohorta.llm import vector_codes
from kohorta.llm.vector_codes import build_block, codes_of, compress_vectors, owned_sums, owners, squares


def brute(vectors, books):
    parts, _, width = books.shape
    cut = vectors.reshape(len(vectors), parts, 1, width)
    gaps = ((cut - books[None]) ** 2).sum(axis=3)
    codes = gaps.argmin(axis=2)
    return codes, np.take_along_axis(gaps, codes[:, :, None], 2).sum(axis=(1, 2))


def clouds(rng, n, width, spread):
    centre = rng.integers(-2000, 2000, (12, width))
    return centre[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, width))


@pytest.mark.parametrize("n,spread", [(1, 5), (40, 3), (700, 60), (700, 1500), (300, 0)])
def test_trees_give_the_sums_and_codes_of_all_pairs(n, spread):
    rng = np.random.default_rng(n + spread)
    vectors = clouds(rng, n, 24, spread)
    block = build_block(vectors, 4)
    books = clouds(rng, 16, 24, 40).reshape(16, 4, 6).transpose(1, 0, 2)
    books[:, 9] = books[:, 3]  # equal entries: the lower one owns
    codes, errors = brute(vectors, books)
    got, error = codes_of(block, books)
    assert (got == codes).all() and (error == errors).all() and not (got == 9).any()
    sums, counts = owned_sums(block, books)
    for p in range(4):
        for e in range(16):
            mine = vectors[codes[:, p] == e, p * 6: p * 6 + 6]
            assert counts[p, e] == len(mine) and (sums[p, e] == mine.sum(axis=0)).all()


def test_balls_hold_their_points():
    vectors = clouds(np.random.default_rng(5), 900, 16, 300)
    block = build_block(vectors, 2)
    size = block.balls[:, 1] - block.balls[:, 0]
    inner = block.balls[:, 2] >= 0
    assert (size[~inner] <= vector_codes.LEAF).all() and inner.sum() > 20
    for i, (a, b, left, right) in enumerate(block.balls):
        assert (block.points[a:b].sum(axis=0) == block.sums[i]).all()
        assert squares(block.points[a:b], block.pivots[i]).max() <= block.radii[i]
        if left >= 0:
            assert (block.balls[left, 0], block.balls[left, 1], block.balls[right, 1]) == (a, block.balls[right, 0], b)
    for p in range(2):
        assert sorted(block.order[p * 900: p * 900 + 900]) == list(range(900))


def test_inherited_lists_shrink():
    """Clustered parts are owned by whole balls: far fewer distances than points times entries."""
    rng = np.random.default_rng(8)
    vectors = clouds(rng, 1024, 64, 12)
    block = build_block(vectors, 8)
    books = vectors[:16].reshape(16, 8, 8).transpose(1, 0, 2)
    balls, _, places, _, products = owners(block, books)
    assert products < 0.25 * 1024 * 8 * 16
    assert (block.balls[balls, 1] - block.balls[balls, 0]).sum() + len(places) == 1024 * 8


def brute_run(rows, parts, entries, rounds, scale):
    kept = [(i, e, label) for i, e, label in rows if e is not None and None not in e and all(map(math.isfinite, e))]
    width = -(-max(len(e) for _, e, _ in kept) // parts)
    scaled = [[max(-(1 << 40), min(1 << 40, math.floor(x * scale))) for x in e] + [0] * (parts * width - len(e)) for _, e, _ in kept]
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i))[:entries]
    start = [min(s for s, k in zip(scaled, kept) if k[0] == i) for i in ids]
    books = np.array(start, object).reshape(len(ids), parts, width).transpose(1, 0, 2)
    vectors = np.array(scaled, object).reshape(len(kept), parts * width)
    for _ in range(rounds):
        codes, _ = brute(vectors, books)
        fresh = books.copy()
        for p in range(parts):
            for e in range(len(ids)):
                mine = vectors[codes[:, p] == e, p * width: (p + 1) * width]
                if len(mine):
                    fresh[p, e] = [int(x) // len(mine) for x in mine.sum(axis=0)]
        books = fresh
    codes, errors = brute(vectors, books)
    of = {}
    for (_, _, label), e in zip(kept, errors):
        of[label] = of.get(label, 0) + int(e)
    short = lambda x: int(x) if x < 1 << 63 else None
    return [(i, tuple(map(int, c)), short(e), short(of[label])) for (i, _, label), c, e in zip(kept, codes, errors)], books


@pytest.mark.parametrize("block", [1024, 7])
def test_rows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)], int(i) % 3 if i % 5 else None) for i in range(150)]
    rows += [(7, rows[90][1], 1), (8, rows[8][1], 2), (None, [0.5] * 12, 1), (None, [0.25] * 12, None), (200, None, 1), (201, [], 4),
             (202, [1.0, None], 1), (203, [math.nan], 1), (204, [math.inf, 1.0], 2), (205, [1.0] * 13, 2), (206, [3e38, -3e38], 9)]
    rows += [(300 + i, [0.125] * 12, 0) for i in range(60)]  # one vector holds a third of the rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, LABEL string, codes int")
    stored = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]
    coded, books = compress_vectors(df, 4, 16, 3, 64)
    want, want_books = brute_run(stored, 4, 16, 3, 64)
    key = lambda r: (r[0] is None, *map(str, r))
    got = [(r.vec_id, tuple(r.codes), r.error, r.label_error) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(r.part, r.entry): r.components for r in books.collect()} == {
        (p, e): [int(x) for x in want_books[p, e]] for p in range(4) for e in range(want_books.shape[1])}


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "a")], "vec_id long, embedding array<double>, label string")
    coded, books = compress_vectors(df)
    assert [tuple(r) for r in coded.collect()] == [(1, "a", [0] * 8, 0, 0)] and books.count() == 8
    coded, books = compress_vectors(df.where("vec_id = 2"))
    assert coded.collect() == [] and books.collect() == []
    empty = spark.createDataFrame([(1, [], "a")], "vec_id long, embedding array<double>, label string")
    assert compress_vectors(empty)[0].first().error == 0
