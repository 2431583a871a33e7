"""Line deduplication by a log-template tree.

A line is its words, those with a digit as a wildcard. The tree has a fixed depth: the number of words, then the leading words.
In a leaf, lines that agree in enough places are linked, and lines joined by links, directly or through others, share a template.
A template found in several documents recurs: its lines stay in the first document, the smallest doc_id, and go from all others.

Leaves are counted first, and a bitmap of fixed size leaves out lines whose leaf only one document has. Equal lines are
one before leaves are formed, so frequent lines cost nothing there. A leaf that fits a task is linked there; the lines of
a larger one are cut into one block of words more than places may differ, so linked lines share a block, and are linked
within the buckets of equal blocks, which gives the same templates.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohorta.llm.text import components, filled, narrow, picked, placed, slices, stage

BITMAP_BITS, LEAF_LINES, LEAF_BYTES = 22, 2_000, 8_000_000
WILDCARD = "<*>"
DROPPED = "__dropped_lines"
DIGIT = re.compile(r"[0-9]")


def masked(line: str) -> list[str]:
    """The words of a line, those with a digit as a wildcard."""
    words = line.split()
    return [WILDCARD if DIGIT.search(w) else w for w in words] if DIGIT.search(line) else words


def _hash(words: list[str], n: int) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(words[:n]).encode("utf-8", "surrogatepass"), seed=len(words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(batch, depth, min_words):
    for doc, text in zip(batch.column("doc_id").to_pylist(), filled(batch.column("text")).to_pylist()):
        if doc is None:
            continue
        for number, line in enumerate(text.split("\n")):
            words = masked(line)
            if len(words) >= min_words:
                yield doc, number, words, _hash(words, depth)


def _count_leaves(depth, min_words):
    def run(batches):
        for batch in slices(batches, limit=16_000_000):
            found: dict[int, list[int]] = {}
            for doc, _, _, leaf in _lines(batch, depth, min_words):
                own = found.get(leaf)
                if own is None:
                    found[leaf] = [doc, doc]
                elif doc < own[0]:
                    own[0] = doc
                elif doc > own[1]:
                    own[1] = doc
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signed(x) for x in found], pa.int64()), pa.array([a for a, _ in found.values()], pa.int64()),
                 pa.array([b for _, b in found.values()], pa.int64())], ["leaf", "lo", "hi"])
    return run


def _cell(leaf):
    return F.shiftrightunsigned(leaf, 64 - BITMAP_BITS).cast("int")


def _keep_shared(cells, depth, min_words):
    wanted = np.zeros(1 << BITMAP_BITS, bool)
    wanted[cells] = True
    packed = np.packbits(wanted)

    def run(batches):
        bitmap = np.unpackbits(packed)
        for batch in slices(batches):
            rows = []
            for doc, number, words, leaf in _lines(batch, depth, min_words):
                if bitmap[leaf >> (64 - BITMAP_BITS)]:
                    line = " ".join(words)
                    rows.append((doc, number, _signed(leaf), xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")), line))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)],
                                             ["doc_id", "number", "leaf", "line_id", "line"])
    return run


def may_differ(n: int, similarity: float) -> int:
    """In how many of n places linked lines may differ."""
    return max((d for d in range(n + 1) if (n - d) / n >= similarity), default=0)


def templates(lines: list[list[str]], similarity: float) -> list[int]:
    """For each line of one length the number of its template in the leaf."""
    if len(lines) == 1:
        return [0]
    vocabulary: dict[str, int] = {}
    left = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in line] for line in lines], np.int32)
    equal = left.shape[1] - may_differ(left.shape[1], similarity)
    numbers, out, found = np.arange(len(lines)), np.zeros(len(lines), np.int64), 0
    while len(left):
        todo, left = [(numbers[0], left[0])], left[1:]
        numbers = numbers[1:]
        while todo:
            at, row = todo.pop()
            out[at] = found
            near = np.count_nonzero(left == row, axis=1) >= equal
            if near.any():
                todo += zip(numbers[near], left[near])
                left, numbers = left[~near], numbers[~near]
        found += 1
    return out.tolist()


def _cluster(similarity):
    """Lines of a leaf or bucket with the smallest line_id they are joined to there."""
    def run(table: pa.Table) -> pa.Table:
        by_length: dict[int, list] = {}
        for line_id, line in zip(table.column("line_id").to_pylist(), table.column("line").to_pylist()):
            words = line.split(" ")
            by_length.setdefault(len(words), []).append((line_id, words))
        ids, roots = [], []
        for own in by_length.values():
            numbers, smallest = templates([words for _, words in own], similarity), {}
            for (line_id, _), t in zip(own, numbers):
                smallest[t] = min(line_id, smallest.get(t, line_id))
            ids += [line_id for line_id, _ in own]
            roots += [smallest[t] for t in numbers]
        return pa.table({"line_id": pa.array(ids, pa.binary()), "template": pa.array(roots, pa.binary())})
    return run


def _blocks(similarity, depth):
    """Each line in its buckets: lines of a leaf that may be linked have at least one block in common."""
    def run(batches):
        for batch in slices(batches, "line"):
            rows = []
            for leaf, line_id, line in zip(*(batch.column(c).to_pylist() for c in ("leaf", "line_id", "line"))):
                words = line.split(" ")
                free, blocks = words[depth:], may_differ(len(words), similarity) + 1
                if len(free) < blocks:  # some block is empty, and all lines of the leaf share it
                    rows.append((leaf, line_id))
                    continue
                ends = [k * len(free) // blocks for k in range(blocks + 1)]
                rows += [(_signed(xxhash.xxh3_64_intdigest("\x00".join([str(leaf), str(k), *free[ends[k]: ends[k + 1]]]).encode(
                    "utf-8", "surrogatepass"))), line_id) for k in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["bucket", "line_id"])
    return run


def _parts(lines: DataFrame, salt: int) -> DataFrame:
    """Lines of buckets (bucket, line_id, line) dealt into parts that fit a task."""
    load = lines.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LEAF_LINES), F.ceil(
        F.sum(F.octet_length("line")) / LEAF_BYTES)).alias("parts"))
    return lines.join(load, "bucket").withColumn("part", F.pmod(F.xxhash64("line_id", F.lit(salt)), "parts"))


def _joined_lines(big: DataFrame, similarity: float, depth: int) -> DataFrame:
    """``_cluster`` of leaves (leaf, line_id, line) of any size.

    Buckets of the same lines are linked once. A bucket over the size of a task is dealt into parts; then one line of each
    template in it is dealt again, as long as that joins most of them, so the lines of a hot template meet through these;
    at last the lines outside the bucket's largest template are compared with all its lines, part by part.
    """
    def linked(parts, *keys):
        found = parts.groupBy("bucket", *keys).applyInArrow(_cluster(similarity), "line_id binary, template binary")
        return stage(found.where("line_id <> template").distinct(), "line-links")

    def joined():
        return stage(components(reduce(DataFrame.unionByName, links).toDF("a", "b")).toDF("line_id", "root"), "line-roots")

    def rooted(lines):
        return lines.join(roots, "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))

    keyed = stage(big.mapInArrow(_blocks(similarity, depth), "bucket long, line_id binary"), "line-blocks")
    same = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line_id")).alias("x"), F.min("line_id").alias("lo"), F.max("line_id").alias("hi")
    buckets = keyed.groupBy("bucket").agg(*same).where("n > 1").groupBy("n", "x", "lo", "hi").agg(F.min("bucket").alias("bucket"))
    lines = stage(_parts(keyed.join(buckets.select("bucket"), "bucket").join(big.select("line_id", "line"), "line_id"), 0), "line-buckets")
    links = [linked(lines, "part")]
    roots, hot, before = joined(), lines.where("parts > 1").select("bucket", "line_id", "line"), None
    while True:
        held = stage(rooted(hot), "line-hot")
        first = held.groupBy("bucket", "root").agg(F.min(F.struct("line_id", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
        now = first.count()
        if not now or before and now > before / 2:
            break
        before = now
        links.append(linked(_parts(first.select("bucket", "first.*"), len(links)), "part"))
        roots = joined()
    if now:
        largest = first.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
        held = held.join(largest, "bucket")
        mine = _parts(held.where("root <> largest").select("bucket", "line_id", "line"), 0)
        every = _parts(held.join(mine.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "line_id", "line"), 0)
        sizes = mine.groupBy("bucket").agg(F.max("parts").alias("rows")).join(
            every.groupBy("bucket").agg(F.max("parts").alias("columns")), "bucket")
        pairs = mine.join(sizes, "bucket").select("bucket", "line_id", "line", F.col("part").alias("row"), F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.col("columns") - 1)).alias("column")).unionByName(
            every.join(sizes, "bucket").select("bucket", "line_id", "line", F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("row"), F.col("part").alias("column")))
        links.append(linked(pairs, "row", "column"))
        roots = joined()
    return rooted(big.select("line_id")).withColumnRenamed("root", "template")


def recurring_lines(documents: DataFrame, similarity: float = 0.8, depth: int = 3, min_docs: int = 2,
                    min_words: int = 4) -> DataFrame:
    """(doc_id, dropped): the numbers of the lines of a document, with their hashes, whose template recurs and began elsewhere."""
    docs = narrow(documents, doc_id="bigint", text="string")
    leaves = docs.mapInArrow(_count_leaves(depth, min_words), "leaf long, lo long, hi long").groupBy("leaf").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    cells = leaves.select(_cell("leaf").alias("cell")).distinct().toArrow()["cell"].to_numpy()  # at most 2 ** BITMAP_BITS
    lines = stage(docs.mapInArrow(_keep_shared(cells, depth, min_words),
                                  "doc_id long, number int, leaf long, line_id binary, line string"), "lines")
    different = stage(lines.groupBy("line_id").agg(F.first("line").alias("line"), F.first("leaf").alias("leaf")), "line-texts")
    large = stage(different.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("bytes")).where(
        (F.col("n") > LEAF_LINES) | (F.col("bytes") > LEAF_BYTES)).select("leaf"), "large-leaves")
    matched = different.join(large, "leaf", "left_anti").groupBy("leaf").applyInArrow(
        _cluster(similarity), "line_id binary, template binary")
    if not large.isEmpty():
        big = stage(different.join(large, "leaf", "left_semi").select("leaf", "line_id", "line"), "large-lines")
        matched = matched.unionByName(_joined_lines(big, similarity, depth))
    found = stage(lines.select("doc_id", "number", "line_id").join(stage(matched, "templates"), "line_id"), "placed")
    recurring = found.groupBy("template", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("template").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    return found.join(recurring, "template").where("doc_id <> first").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("number", "line_id"))).alias("dropped"))


def _remove(columns, text_column):
    def run(batches):
        for batch in slices(batches, text_column):
            texts, counts, gone = [], [], []
            for text, dropped in zip(batch.column(text_column).to_pylist(), batch.column(DROPPED).to_pylist()):
                lines = (text or "").split("\n")
                out = {d["number"] for d in dropped or () if d["number"] < len(lines) and xxhash.xxh3_128_digest(
                    " ".join(masked(lines[d["number"]])).encode("utf-8", "surrogatepass")) == d["line_id"]}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
                counts.append(len(lines) if text is not None else 0)
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(texts, pa.string()) if c == text_column else batch.column(c) for c in columns],
                 pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*columns, "n_lines", "n_dropped"])
    return run


def without_recurring_lines(documents: DataFrame, similarity: float = 0.8, depth: int = 3, min_docs: int = 2,
                            min_words: int = 4) -> DataFrame:
    """The documents (doc_id, text, ...), all columns kept, without the recurring lines of all but the first document, and
    n_lines (before) and n_dropped, which replace columns of these names.

    Lines of fewer than ``min_words`` words and blank lines stay. A missing text stays missing, with no lines; a row without
    doc_id stays as it is; rows of one doc_id are one document, so lines that repeat only among them stay. An empty table
    gives an empty result.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    lost = recurring_lines(documents, similarity, depth, min_docs, min_words).toDF("lost_id", DROPPED)
    kept = placed(picked(documents, *names))
    doc, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    joined = kept.join(lost, F.col(doc).cast("bigint") == F.col("lost_id"), "left").drop("lost_id")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_remove(kept.columns, text), schema).toDF(*names, "n_lines", "n_dropped")
