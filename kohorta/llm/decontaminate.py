"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents. Its words are numbered, its suffixes sorted, and the Burrows-Wheeler
transform put in a wavelet matrix. Phrases, streamed past every shard in blocks from a written stage, are
searched backwards by two ranks a word; occurrences are located by walking to the nearest sampled suffix position,
and the covered words of each document are merged into spans.

Before indexing, words that no phrase holds become breaks and runs shorter than the shortest phrase are left
out: no phrase can occur there. The test is a bitmap of fixed size over word hashes; a false positive only indexes more. Words
are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import alnum_hashes, file_system, narrow, placed, signed, slices
from kohorta.session import scratch_path

BITMAP_BITS, SAMPLE, SHARD_BYTES, PHRASES_AT_ONCE = 22, 8, 8_000_000, 20_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMPTY_LIST = hashlib.sha256(b"").hexdigest()


class BitRanks:
    """A bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(packed) // 8) * 8 + 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i):
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i):
        """Ones before place i."""
        part = self.words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6] + np.bitwise_count(part)


class WaveletMatrix:
    """Rank and access over a sequence of numbers below ``sigma``, one bit vector a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.shifts = range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        self.levels = []
        for shift in self.shifts:
            bits = ((symbols >> shift) & 1).astype(bool)
            zeros = symbols[~bits]
            self.levels.append((BitRanks(bits), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bits]])

    def _follow(self, symbol, i):
        for shift, (bits, zeros) in zip(self.shifts, self.levels):
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol, i):
        """How often each symbol stands before place i."""
        return self._follow(symbol, i) - self._follow(symbol, np.zeros_like(i))

    def access(self, i):
        """The symbols at places i and how often each stands before its place."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for shift, (bits, zeros) in zip(self.shifts, self.levels):
            bit, ones, first = bits.get(i).astype(bool), bits.rank(i), bits.rank(start)
            i, start = np.where(bit, zeros + ones, i - ones), np.where(bit, zeros + first, start - first)
            symbol |= bit.astype(np.int64) << shift
        return symbol, i - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length."""
    ranks, n, step = symbols.astype(np.int64), len(symbols), 1
    ranks = np.unique(ranks, return_inverse=True)[1]
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - step)] = ranks[step:] + 1
        key = ranks * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        ranks = np.empty(n, np.int64)
        ranks[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search over one shard. Symbol 0 ends the text, 1 is a break, words count from 2."""

    def __init__(self, words: np.ndarray, breaks: np.ndarray):
        """words: hashes in a row; breaks: True where a break stands before the word."""
        self.alphabet = np.unique(words)
        symbols = np.searchsorted(self.alphabet, words) + 2
        place = np.arange(len(words)) + np.cumsum(breaks)
        text = np.ones(len(words) + int(breaks.sum()) + 2, np.int64)
        text[place] = symbols
        text[-1] = 0
        self.origin = np.full(len(text), -1, np.int64)
        self.origin[place] = np.arange(len(words))
        order = suffix_order(text)
        sigma = len(self.alphabet) + 2
        self.n, self.tree = len(text), WaveletMatrix(text[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = BitRanks(sampled), order[sampled]

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase."""
        sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        flat = np.concatenate([np.zeros(0, np.uint64), *phrases])
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        known, symbol = self.alphabet[at] == flat, at + 2
        ends = np.cumsum(sizes)
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        unknown = np.concatenate([[0], np.cumsum(~known)])
        high[(unknown[ends] - unknown[ends - sizes] > 0) | (sizes == 0)] = 0
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero((sizes >= back) & (low < high))
            if not len(live):
                break
            s = symbol[ends[live] - back]
            low[live] = self.first[s] + self.tree.rank(s, low[live])
            high[live] = self.first[s] + self.tree.rank(s, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the given words of the suffixes in ``rows``."""
        out, rows, steps = np.full(len(rows), -1, np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            now = rows[open_]
            hit = self.sampled.get(now).astype(bool)
            out[open_[hit]] = self.positions[self.sampled.rank(now[hit])] + steps[open_[hit]]
            open_, now = open_[~hit], now[~hit]
            symbol, before = self.tree.access(now)
            rows[open_] = self.first[symbol] + before
            steps[open_] += 1
        return self.origin[out]


def phrase_rows(window: int):
    """Every ``window`` words in a row of an item; a shorter item is one phrase; an item without words none."""
    def run(batches):
        for batch in slices(batches, limit=1_000_000):
            hashes, offsets = alnum_hashes(batch.column("text"))
            items, phrases = [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), offsets[:-1], offsets[1:]):
                for at in range(a, max(a, b - window) + 1 if b > a else a):
                    items.append(item)
                    phrases.append(signed(hashes[at: min(b, at + window)]))
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(phrases, pa.list_(pa.int64()))],
                                                 ["item_id", "words"])
    return run


def _phrase_blocks(path):
    import pyarrow.dataset as ds

    system, plain = file_system(path)
    for batch in ds.dataset(plain, filesystem=system, format="parquet").to_batches(
            columns=["item_id", "words"], batch_size=PHRASES_AT_ONCE):
        lists = batch.column("words")
        values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        yield batch.column("item_id").to_pylist(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _shard_hits(hashes, offsets, cells, shortest, path):
    """Which words are covered, and the items found in each document."""
    covered, items = np.zeros(len(hashes) + 1, np.int64), [set() for _ in offsets[1:]]
    if not len(hashes) or not shortest:
        return covered[:-1] > 0, items
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[cells] = True
    known = bitmap[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
    starts = np.zeros(len(hashes) + 1, bool)
    starts[offsets] = True
    begins = known & (starts[:-1] | ~np.concatenate([[False], known[:-1]]))
    run = np.cumsum(begins) - 1
    long = known.copy()
    long[known] = np.bincount(run[known])[run[known]] >= shortest
    kept = np.flatnonzero(long)
    if not len(kept):
        return covered[:-1] > 0, items
    index = FMIndex(hashes[kept], begins[kept])
    for owners, phrases in _phrase_blocks(path):
        low, high = index.search(phrases)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        phrase = np.repeat(found, counts)
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(phrase))
        at = kept[index.locate(rows.astype(np.int64))]
        sizes = np.fromiter((len(phrases[p]) for p in found), np.int64, len(found)).repeat(counts)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + sizes, -1)
        for d, p in set(zip((np.searchsorted(offsets, at, side="right") - 1).tolist(), phrase.tolist())):
            items[d].add(owners[p])
    return np.cumsum(covered)[:-1] > 0, items


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    words = [m.span() for m in WORD.finditer(raw.lower())]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at: words[a][0]])
        at = words[b - 1][1]
    return b"".join([*parts, raw[at:]]).decode()


def _judge(cells, shortest, path, doc_column="doc_id", text_column="text", clean=False):
    def run(batches):
        for batch in slices(batches, text_column, SHARD_BYTES):
            hashes, offsets = alnum_hashes(batch.column(text_column))
            covered, items = _shard_hits(hashes, offsets, cells, shortest, path)
            edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            opened = covered.copy()
            opened[1:] &= ~covered[:-1]
            inner = offsets[(offsets > 0) & (offsets < len(covered))]
            opened[inner] = covered[inner]
            starts = np.flatnonzero(opened)
            closes = np.flatnonzero(edges == -1)
            stops = np.minimum(closes[np.searchsorted(closes, starts, side="right")] if len(starts) else starts,
                               offsets[np.searchsorted(offsets, starts, side="right")] if len(starts) else starts)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            spans = [[] for _ in items]
            for d, a, b in zip(doc.tolist(), starts.tolist(), stops.tolist()):
                spans[d].append((a - int(offsets[d]), b - int(offsets[d])))
            named = [",".join(sorted(map(str, found))) for found in items]
            hits = [sum(b - a for a, b in s) for s in spans]
            out = {"doc_id": batch.column(doc_column), "n_words": pa.array(np.diff(offsets)),
                   "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                   "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() if x else EMPTY_LIST for x in named]),
                   "contaminated": pa.array([h > 0 for h in hits]),
                   "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans],
                                     pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))}
            if clean:
                texts = [None if t is None else without_words(t, s) if s else t
                         for t, s in zip(batch.column(text_column).to_pylist(), spans)]
                out = {**{c: batch.column(c) for c in batch.schema.names}, text_column: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)
    return run


def _phrases(documents: DataFrame, benchmark: DataFrame, window: int):
    items = narrow(benchmark, item_id="bigint", text="string")
    phrases = items.mapInArrow(phrase_rows(window), "item_id long, words array<long>")
    path = scratch_path(documents.sparkSession, "phrases")
    phrases.write.parquet(path)
    phrases = documents.sparkSession.read.schema(phrases.schema).parquet(path)
    shortest = phrases.agg(F.min(F.size("words"))).first()[0] or 0
    cell = F.shiftrightunsigned("word", 64 - BITMAP_BITS).alias("cell")
    cells = phrases.select(F.explode("words").alias("word")).select(cell).distinct().toArrow()["cell"].to_numpy()  # at most 2 ** BITMAP_BITS numbers
    return cells.astype(np.int64), shortest, path


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of documents (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated and the merged spans of
    words (start, stop) that occurrences of the phrases of benchmark (item_id, text) cover.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Missing and empty texts have no
    words and no hits; an empty benchmark hits nothing; repeated rows are each judged; a missing item_id counts as
    an item named None; an empty table gives an empty result.
    """
    cells, shortest, path = _phrases(documents, benchmark, window)
    docs = narrow(documents, doc_id="bigint", text="string")
    return docs.mapInArrow(_judge(cells, shortest, path),
                           "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                           "spans array<struct<start: long, stop: long>>")


def without_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns kept, with the spans of ``contamination`` cut out of their texts."""
    cells, shortest, path = _phrases(documents, benchmark, window)
    rows = placed(documents)
    doc, text = (f"c{documents.columns.index(c)}" for c in ("doc_id", "text"))
    return rows.mapInArrow(_judge(cells, shortest, path, doc, text, clean=True), rows.schema).toDF(*documents.columns)
