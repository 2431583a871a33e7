"""Words, hashes and bounded Arrow batches shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.session import drop_stages, stage

#: Bytes of text handled at once inside a task; one longer text is still handled whole.
SLICE_BYTES = 4_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: A-Z lower-cased, which bytes belong to a word, and the first 0 to 8 bytes of a block.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: ASCII letters and digits stay (letters lower-cased), other ASCII becomes a blank, the rest of Unicode stays.
ALNUM = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, the first of each: other columns never reach an operator, whatever
    their names, also such as differ in case only."""
    places = [df.columns.index(n) for n in names]
    return placed(df).select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names)])


def narrow(df: DataFrame, **types: str) -> DataFrame:
    """``picked`` columns in the named types."""
    return picked(df, *types).select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def placed(df: DataFrame) -> DataFrame:
    """The same columns named by place, c0, c1 and so on, for functions that pass all of them through."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def filled(texts: pa.Array) -> pa.Array:
    """Missing texts as empty ones, in the type with 64-bit offsets."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def hash_words(values: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    coded = values.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()),
                        np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)


def _hash_lists(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    return hash_words(pa.array(list(chain.from_iterable(lists)), pa.large_binary())), offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII blanks, A-Z lower-cased, and where each text's words start.

    All texts are read as one run of bytes, and eight bytes of every word at a time; no word becomes an object of its own
    unless it is long.
    """
    texts = filled(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    n = int(edges[-1] - edges[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    data = np.zeros(n + 8, np.uint8)
    np.take(LOWER, np.frombuffer(texts.buffers()[2], np.uint8)[edges[0]: edges[-1]], out=data[:n])
    edges = edges - edges[0]
    inside = IN_WORD[data[:n]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    for marks, own in ((first, edges[edges < n]), (last, edges[edges > 0] - 1)):  # no word goes on into the next text
        marks[own] = inside[own]
    at, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = ends - at
    blocks = np.ndarray((n + 1,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = size.astype(np.uint64) * GOLDEN
    done, left = 0, np.flatnonzero(size <= LONG_WORD)
    while len(left):
        block = blocks[at[left] + done] & FIRST_BYTES[np.minimum(size[left] - done, 8)]
        hashes[left] = mixed(hashes[left] ^ block)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[at[i]: ends[i]])
    return hashes, np.searchsorted(at, edges)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys (64 bits, unsigned) and the place of every key among them.

    Numbers sort many times faster than places by number, so each key carries its place in its lowest bits; keys that are
    equal above these are put in order afterwards.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    low = keys.min()
    spread = 64 - int(keys.max() - low).bit_length()
    places = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    carried = (keys - low) << np.uint64(spread) if spread < 64 else np.zeros_like(keys)
    order = (np.sort((carried & ~places) | np.arange(len(keys), dtype=np.uint64)) & places).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        again = np.argsort(ordered, kind="stable")  # nearly sorted, so this is one merge
        order, ordered = order[again], ordered[again]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def alnum_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return _hash_lists([t.translate(ALNUM).split() for t in filled(texts).cast(pa.large_binary()).to_pylist()])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; order matters."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = mixed(words[: len(words) - n + 1] + GOLDEN)
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = mixed(out * np.uint64(31) + words[i: len(words) - n + 1 + i])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def file_system(path: str):
    """The file system and plain path of a folder that executors share."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", path if "://" in path or path.startswith("file:") else f"file://{path}")
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    Every round hangs each neighbourhood on its smallest member, first the larger neighbours and then all,
    which at least halves long chains; only distinct edges are shuffled and no neighbourhood is gathered.
    """
    pairs = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a > b").distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                 F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
                 .where("a > b").distinct())
        following = stage(small, "edges")
        same = following.exceptAll(pairs).isEmpty() and following.count() == pairs.count()
        drop_stages(pairs)
        pairs = following
        if same:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    raise RuntimeError("components did not settle")
