"""Language-model scores by deleted interpolation.

Counts of all one-, two- and three-word sequences are gathered exactly. Texts are read in chunks; a chunk sends its distinct
sequences once, as sorted hashes cut into buckets, with its own counts. A bucket adds up what all chunks sent and sends
each chunk what others add to its counts, in the order in which it asked. So a sequence costs one entry per chunk and not one
per occurrence, frequent ones are summed before they move, and no key can make a bucket heavy.

The probability of a word is a nested mixture of the maximum-likelihood estimates of the three orders and a uniform floor.
The weight of an order depends on how frequent its context is, in powers of two. Weights are
learned by expectation-maximisation on a held-out fifth of the learning texts, whose own counts are deleted from the totals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import GOLDEN, distinct_keys, file_system, mixed, narrow, slices, stage, word_hashes
from kohorta.session import scratch_path

CHUNK_BYTES, BUCKET_BYTES, ITERATIONS, FREQUENCIES, STEPS = 4_000_000, 4_000_000, 15, 24, 4
#: No weight takes all, so that every word keeps a probability.
HEAVIEST = 0.99999
END, BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, each compressed by its own code: small numbers become short."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    out = zstandard.ZstdCompressor(1).compressobj(size=planes.size)
    parts = [part for plane in planes for part in (out.compress(plane.tobytes()), out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))]
    return b"".join([*parts, out.flush()])


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps of their upper 56 bits beside the lowest byte: the denser the keys, the fewer bytes each."""
    high = keys & ~np.uint64(255)
    return _pack(np.diff(high, prepend=np.uint64(0)) | (keys & np.uint64(255)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    steps = _unpack(blob)
    return np.cumsum(steps & ~np.uint64(255), dtype=np.uint64) | (steps & np.uint64(255))


def _keyed(x: np.ndarray, order: int) -> np.ndarray:
    """The lowest two bits say the order, 0 for the mark before a text. Single words have hashes of 61 bits. Longer
    sequences, which are most, have 55 bits and lie in the upper half, so that their lowest byte costs nothing to send."""
    x = mixed(x) >> np.uint64(1)
    return (x & ~np.uint64(255)) | np.uint64((1 << 63) + order) if order > 1 else (x & ~np.uint64(3)) | np.uint64(order)


class Chunk:
    """The tokens of some texts: words and one end each, with the keys of their sequences."""

    def __init__(self, texts):
        words, offsets = word_hashes(texts)
        self.sizes = np.diff(offsets) + 1
        self.starts = offsets[:-1] + np.arange(len(self.sizes))
        n = len(words) + len(self.sizes)
        tokens = np.full(n, END)
        inner = np.ones(n, bool)
        inner[self.starts + self.sizes - 1] = False
        tokens[inner] = words
        one, two = np.concatenate([[BEGIN], tokens[:-1]]), np.concatenate([[BEGIN, BEGIN], tokens[:-2]])[:n]
        one[self.starts], two[self.starts] = BEGIN, BEGIN
        second = self.starts[self.sizes > 1] + 1
        two[second] = BEGIN
        with np.errstate(over="ignore"):
            context = mixed(one + GOLDEN * two)
            pairs, begin = mixed(tokens + GOLDEN * one), np.array([BEGIN])
            keys = np.concatenate([_keyed(tokens, 1), _keyed(pairs, 2), _keyed(tokens * GOLDEN + context, 3),
                                   _keyed(begin, 0), _keyed(mixed(begin + GOLDEN * begin), 2)])
        self.keys, place = distinct_keys(keys)
        self.uni, self.bi, self.tri = place[:n], place[n: 2 * n], place[2 * n: 3 * n]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.concatenate([[0], self.uni[:-1]])
        before[self.starts] = place[3 * n]
        self.context1 = before
        before = np.concatenate([[0], self.bi[:-1]])
        before[self.starts] = place[3 * n + 1]
        self.context2, self.begin = before, (place[3 * n], place[3 * n + 1])

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each key occurs in the chosen texts; the marks once a text."""
        at, out = chosen[self.doc], np.zeros(len(self.keys), np.int64)
        for place in (self.uni, self.bi, self.tri):
            out += np.bincount(place[at], minlength=len(out))
        out[list(self.begin)] += int(chosen.sum())
        return out

    def cuts(self, bits: int) -> np.ndarray:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])


def _chunks(batches):
    """The same chunks whenever the same partition is read."""
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(slices(batches, limit=CHUNK_BYTES)):
        fold = batch.column("fold").fill_null(-1).to_numpy()
        yield part, seq, batch, fold, Chunk(batch.column("text"))


def _send(bits, learn, held):
    def run(batches):
        for part, seq, _, fold, chunk in _chunks(batches):
            learned, deleted = chunk.counts(np.isin(fold, learn)), chunk.counts(fold == held)
            cuts = chunk.cuts(bits)
            for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": pa.array([bucket], pa.int32()), "part": pa.array([part], pa.int32()),
                         "seq": pa.array([seq], pa.int32()), "keys": [_pack_keys(chunk.keys[a:b])],
                         "learned": [_pack(learned[a:b])], "deleted": [_pack(deleted[a:b])]})
    return run


def _add_up(table: pa.Table) -> pa.Table:
    keys = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
    known, place = distinct_keys(np.concatenate(keys))
    sizes = np.cumsum([0, *map(len, keys)])
    totals, back = [], []
    spans = list(zip(sizes[:-1], sizes[1:]))
    for column in ("learned", "deleted"):
        total, own = np.zeros(len(known), np.int64), table.column(column).to_pylist()
        for (a, b), blob in zip(spans, own):
            total[place[a:b]] += _unpack(blob).astype(np.int64)  # a chunk sends a key once
        totals.append(total)
        mine = [_unpack(blob).astype(np.int64) for blob in own]
        # only keys of held-out texts are asked for what others delete, and those a chunk deletes itself
        back.append([_pack((total[place[a:b]] - x) * ((x > 0) if column == "deleted" else 1)) for (a, b), x in zip(spans, mine)])
    word = (known & np.uint64(3)) == 1
    facts = [int((totals[0][word] > 0).sum()), int(totals[0][word].sum()), int(totals[1][word].sum())]
    rest = [0] * (len(keys) - 1)
    return pa.table({
        "part": table.column("part"), "seq": table.column("seq"), "bucket": table.column("bucket"),
        "check": pa.array([xxhash.xxh3_64_intdigest(k.tobytes()) >> 1 for k in keys], pa.int64()),
        "learned": pa.array(back[0]), "deleted": pa.array(back[1]),
        "distinct": pa.array([facts[0], *rest], pa.int64()), "tokens": pa.array([facts[1], *rest], pa.int64()),
        "held_tokens": pa.array([facts[2], *rest], pa.int64())})


TOTALS = ("part int, seq int, bucket int, check long, learned binary, deleted binary, distinct long, tokens long, "
          "held_tokens long")


class Totals:
    """What the buckets sent back to one partition, added to the own counts of a chunk."""

    def __init__(self, path, bits):
        self.path, self.bits, self.part = path, bits, None

    def __call__(self, part, seq, chunk, **own):
        if self.part != part:
            import pyarrow.dataset as ds

            system, plain = file_system(f"{self.path}/part={part}")
            self.part, self.data = part, ds.dataset(plain, filesystem=system, format="parquet")
        import pyarrow.compute as pc

        found = self.data.to_table(columns=["bucket", "check", *own], filter=pc.field("seq") == seq)
        cuts = chunk.cuts(self.bits)
        own, done = {c: x.copy() for c, x in own.items()}, 0
        for row in found.to_pylist():
            a, b = cuts[row["bucket"]], cuts[row["bucket"] + 1]
            if row["check"] != xxhash.xxh3_64_intdigest(chunk.keys[a:b].tobytes()) >> 1:
                raise RuntimeError("the texts are not read in the same order each time; pass a written table")
            for column, counts in own.items():
                counts[a:b] += _unpack(row[column]).astype(np.int64)
            done += b - a
        if done != len(chunk.keys):
            raise RuntimeError("counts of a chunk are missing; pass a written table")
        return own


def _frequency(context):
    """The bucket of a context: 0 if it was never seen, else its size in powers of two."""
    return np.minimum(np.floor(np.log2(np.maximum(context, 0.5))) + 1, FREQUENCIES - 1).astype(np.int64)


def _estimates(chunk, counts, n_tokens):
    with np.errstate(divide="ignore", invalid="ignore"):
        c1, c2 = counts[chunk.context1], counts[chunk.context2]
        f1 = counts[chunk.uni] / max(n_tokens, 1)
        f2 = np.where(c1 > 0, counts[chunk.bi] / np.maximum(c1, 1), 0.0)
        f3 = np.where(c2 > 0, counts[chunk.tri] / np.maximum(c2, 1), 0.0)
    return f1, f2, f3, _frequency(c1), _frequency(c2)


def _grid(f):
    """Estimates on a logarithmic grid of quarter octaves; 0 is no estimate."""
    return np.where(f > 0, np.minimum(1 + np.round(-STEPS * np.log2(np.where(f > 0, f, 1))), 255), 0).astype(np.int64)


def _cell(b3, b2, g3, g2, g1):
    return (((b3 * 32 + b2) * 256 + g3) * 256 + g2) * 256 + g1


def _held_out(path, bits, learn, held, n_tokens):
    def run(batches):
        totals = Totals(path, bits)
        for part, seq, _, fold, chunk in _chunks(batches):
            own = (fold == held)[chunk.doc]
            if not own.any():
                continue
            counts = totals(part, seq, chunk, learned=chunk.counts(np.isin(fold, learn)), deleted=chunk.counts(fold == held))
            f1, f2, f3, b2, b3 = (x[own] for x in _estimates(chunk, counts["learned"] - counts["deleted"], n_tokens))
            cells, n = np.unique(_cell(b3, b2, _grid(f3), _grid(f2), _grid(f1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])
    return run


def learn_weights(cells: DataFrame, floor: float, iterations: int = ITERATIONS) -> dict[str, np.ndarray]:
    """Expectation-maximisation on held-out counts: cells (b3, b2, g3, g2, g1, n) on the grid of ``_grid``."""
    def value(grid):
        return F.when(F.col(grid) > 0, F.pow(F.lit(2.0), (1 - F.col(grid)) / STEPS)).otherwise(F.lit(0.0))

    rows = cells.select("b3", "b2", "n", *[value(f"g{i}").alias(f"f{i}") for i in (1, 2, 3)])
    weights = {"w3": np.full(FREQUENCIES, 0.5), "w2": np.full(FREQUENCIES, 0.5), "w1": np.array([0.9])}
    weights["w3"][0] = weights["w2"][0] = 0.0
    for _ in range(iterations):
        def at(name, bucket):
            return F.element_at(F.array(*[F.lit(float(x)) for x in weights[name]]), F.col(bucket) + 1)

        p1 = F.lit(float(weights["w1"][0])) * F.col("f1") + F.lit(float((1 - weights["w1"][0]) * floor))
        scored = (rows.withColumn("p1", p1).withColumn("l2", at("w2", "b2")).withColumn("l3", at("w3", "b3"))
                  .withColumn("p2", F.col("l2") * F.col("f2") + (1 - F.col("l2")) * F.col("p1"))
                  .withColumn("p3", F.col("l3") * F.col("f3") + (1 - F.col("l3")) * F.col("p2")))
        r3 = F.col("l3") * F.col("f3") / F.col("p3")
        r2 = (1 - r3) * F.col("l2") * F.col("f2") / F.col("p2")
        r1 = (1 - r3) * (1 - F.col("l2") * F.col("f2") / F.col("p2"))
        known = F.lit(float(weights["w1"][0])) * F.col("f1") / F.col("p1")
        sums = scored.groupBy("b3", "b2").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * r3).alias("s3"), F.sum(F.col("n") * r2).alias("s2"),
            F.sum(F.col("n") * (1 - r3)).alias("n2"), F.sum(F.col("n") * r1 * known).alias("s1"),
            F.sum(F.col("n") * r1).alias("n1")).collect()  # at most FREQUENCIES ** 2 rows
        if not sums:
            break
        for name, bucket, part, whole in (("w3", "b3", "s3", "n"), ("w2", "b2", "s2", "n2")):
            top, all_ = np.zeros(FREQUENCIES), np.zeros(FREQUENCIES)
            for r in sums:
                top[r[bucket]] += r[part]
                all_[r[bucket]] += r[whole]
            weights[name] = np.where(all_ > 0, np.minimum(top / np.maximum(all_, 1e-300), HEAVIEST), weights[name])
            weights[name][0] = 0.0
        n1 = sum(r["n1"] for r in sums)
        weights["w1"] = np.array([min(HEAVIEST, sum(r["s1"] for r in sums) / n1)]) if n1 > 0 else weights["w1"]
    return weights


def _score(path, bits, learn, weights, n_tokens, distinct, out_fold):
    floor = 1.0 / (distinct + 1)

    def run(batches):
        totals = Totals(path, bits)
        for part, seq, batch, fold, chunk in _chunks(batches):
            counts = totals(part, seq, chunk, learned=chunk.counts(np.isin(fold, learn)))["learned"]
            f1, f2, f3, b2, b3 = _estimates(chunk, counts, n_tokens)
            p = weights["w1"][0] * f1 + (1 - weights["w1"][0]) * floor
            p = weights["w2"][b2] * f2 + (1 - weights["w2"][b2]) * p
            p = weights["w3"][b3] * f3 + (1 - weights["w3"][b3]) * p
            own = counts[chunk.uni]
            base = np.log10((own + 0.5) / (n_tokens + 0.5 * (distinct + 1)))
            n = len(fold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fold == out_fold), pa.array(chunk.sizes),
                 pa.array(np.add.reduceat((own > 0).astype(np.int64), chunk.starts)), pa.array(np.full(n, n_tokens)),
                 pa.array(np.add.reduceat(base, chunk.starts)), pa.array(np.add.reduceat(np.log10(p), chunk.starts))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def interpolated_scores(documents: DataFrame, folds: int = 5, out_fold: int = 1, weight_fold: int = 0,
                        text_bytes_per_bucket: int = BUCKET_BYTES) -> DataFrame:
    """Scores of every row of documents (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The fold of a row is crc32 of its doc_id as text, modulo ``folds``. All folds but ``out_fold`` are learned from; the
    mixture weights come from ``weight_fold``. Words stand between ASCII blanks, A-Z lower-cased; a text ends with one
    end token. A missing text is empty; a row without doc_id is scored, neither learned from nor held out; repeated
    rows count each; an empty table gives an empty result. ``documents`` must read its rows in the same order
    each time, as files do; another order is noticed and raises.
    """
    spark = documents.sparkSession
    docs = narrow(documents, doc_id="bigint", text="string").withColumn(
        "fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)).cast("int"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / text_bytes_per_bucket))))
    learn = [f for f in range(folds) if f != out_fold]
    sent = docs.mapInArrow(_send(bits, learn, weight_fold),
                           "bucket int, part int, seq int, keys binary, learned binary, deleted binary")
    path = scratch_path(spark, "ngram-totals")
    sent.groupBy("bucket").applyInArrow(_add_up, TOTALS).repartition("part").write.partitionBy("part").parquet(path)
    totals = spark.read.schema(TOTALS).parquet(path)
    facts = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "tokens", "held_tokens")]).first()
    held = docs.mapInArrow(_held_out(path, bits, learn, weight_fold, facts.tokens - facts.held_tokens), "cell long, n long")
    digits = {"b3": (29, 31), "b2": (24, 31), "g3": (16, 255), "g2": (8, 255), "g1": (0, 255)}
    cells = stage(held.groupBy("cell").agg(F.sum("n").alias("n")).select(
        *[F.shiftright("cell", at).bitwiseAND(mask).cast("int").alias(c) for c, (at, mask) in digits.items()], "n"),
        "held-out-counts")
    weights = learn_weights(cells, 1.0 / (facts.distinct + 1))
    return docs.mapInArrow(_score(path, bits, learn, weights, facts.tokens, facts.distinct, out_fold),
                           "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                           "base_score double, score double")
