"""Token ids in Arrow files of fixed-size lists.

The ids of all documents, in ascending doc_id order, are one stream. Every range of documents becomes a shard:
``shard-N.arrow`` in the random-access Arrow file format holds its ids cut into sequences of equal length with a
mask (false behind the last id), in batches of a fixed number of sequences, so that sequence i is a view into a mapped
file. ``shard-N.docs.arrow`` says where each document starts. Shards are written under a name of their own and
renamed when complete: a repeated task replaces its file by an equal one.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import file_system, filled, narrow, slices, stage
from kohorta.llm.tokens import encoder

BATCH_SEQUENCES = 256


class SequenceFile:
    """Random access to the equal-length sequences of a shard; arrays are views where the file can be mapped."""

    def __init__(self, path: str):
        system, plain = file_system(path)
        self.source = pa.memory_map(plain) if system.type_name == "local" else system.open_input_file(plain)
        self.reader = pa.ipc.open_file(self.source)
        meta = self.reader.schema.metadata
        self.length, self.per_batch = int(meta[b"length"]), int(meta[b"batch_sequences"])
        self.n_ids = int(self.reader.schema.metadata.get(b"n_ids", b"-1"))

    def __len__(self):
        last = self.reader.num_record_batches - 1
        return 0 if last < 0 else last * self.per_batch + self.reader.get_batch(last).num_rows

    def _column(self, i, name):
        batch = self.reader.get_batch(i // self.per_batch)
        return batch.column(name).slice(i % self.per_batch, 1).flatten()

    def ids(self, i: int) -> np.ndarray:
        return self._column(i, "ids").to_numpy()

    def mask(self, i: int) -> np.ndarray:
        return self._column(i, "mask").to_numpy(zero_copy_only=False)

    def all_ids(self) -> np.ndarray:
        """The ids of the shard's documents without the filling."""
        parts = [np.zeros(0, np.uint16)]
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            ids = batch.column("ids").flatten().to_numpy()
            mask = batch.column("mask").flatten()
            valid = len(mask) if i + 1 < self.reader.num_record_batches else mask.true_count
            parts.append(ids[:valid])
        return np.concatenate(parts[1:] or parts)


class _Shard:
    def __init__(self, folder, shard, kind, length):
        self.system, base = file_system(folder)
        self.system.create_dir(base, recursive=True)
        self.paths = {k: f"{base}/shard-{shard:05d}{k}" for k in (".arrow", ".docs.arrow")}
        self.uri = f"{folder}/shard-{shard:05d}.arrow"
        self.own = {k: f"{base}/_{uuid.uuid4().hex}{k}" for k in self.paths}
        self.kind, self.length, self.rest, self.n_ids = kind, length, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))],
                                {"length": str(length), "batch_sequences": str(BATCH_SEQUENCES)})
        self.sink = self.system.open_output_stream(self.own[".arrow"])
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.docs = 0, []

    def add(self, doc, ids):
        self.docs.append((doc, self.n_ids, len(ids), len(self.docs)))
        self.rest.append(ids)
        self.n_ids += len(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH_SEQUENCES * self.length:
            self._flush(False)

    def _flush(self, last):
        ids = np.concatenate([np.zeros(0, self.kind), *self.rest])
        per_batch = BATCH_SEQUENCES * self.length
        upto = len(ids) if last else len(ids) // per_batch * per_batch
        for at in range(0, upto, per_batch):
            part = ids[at: at + per_batch]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, self.kind)
            full[: len(part)] = part
            self.writer.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(full), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(full)) < len(part)), self.length)], schema=self.schema))
        self.rest, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self):
        self._flush(True)
        self.writer.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array([d[0] for d in self.docs], pa.int64()),
                          "start": pa.array([d[1] for d in self.docs], pa.int64()),
                          "n_tokens": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.system.open_output_stream(self.own[".docs.arrow"]) as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        for k, path in self.paths.items():
            self.system.move(self.own[k], path)
        return len(self.docs), self.n_ids


def _write(folder, tokenizer, chunks, end_id, kind, length):
    def run(batches):
        encode, shard = encoder(tokenizer, chunks), TaskContext.get().partitionId()
        out, end = None, np.array([end_id], kind)
        for batch in slices(batches):
            out = out or _Shard(folder, shard, kind, length)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(filled(batch.column("text")).to_pylist())):
                out.add(doc, np.concatenate([np.frombuffer(ids, "<u4").astype(kind), end]))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [out.uri],
                                              "n_docs": [n_docs], "n_ids": [n_ids]})
    return run


def write_token_files(documents: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", chunks: str = "leading",
                      end_id: int = 0, length: int = 2048, vocabulary: int = 50_257) -> DataFrame:
    """Write the shards of documents (doc_id, text) into ``folder`` and return the manifest, one row per shard in order.

    Documents follow doc_id, missing ids first, equal ids by text. A missing or empty text is its end id. An empty
    table writes no shard. Ids take two bytes where the vocabulary allows it.
    """
    docs = narrow(documents, doc_id="bigint", text="string")
    kind = "uint16" if vocabulary <= 1 << 16 else "uint32"
    ranged = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stage(ranged.mapInArrow(_write(folder, tokenizer, chunks, end_id, kind, length),
                                   "shard int, path string, n_docs long, n_ids long"), "manifest")


def _read(batches):
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            shard = SequenceFile(path)
            ids = shard.all_ids()
            system, plain = file_system(path.replace(".arrow", ".docs.arrow"))
            with system.open_input_file(plain) as source:
                index = pa.ipc.open_file(source).read_all()
            starts, sizes = index["start"].to_numpy(), index["n_tokens"].to_numpy()
            crc = [zlib.crc32(ids[a: a + n].astype("<u4").tobytes()) for a, n in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [index["doc_id"].combine_chunks(), pa.array(starts + base), pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole stream, n_tokens and the checksum of its ids."""
    shards = sorted(manifest.collect(), key=lambda r: r.shard)  # one row per shard
    rows, base = [], 0
    for r in shards:
        rows.append((r.path, base))
        base += r.n_ids
    spark = manifest.sparkSession
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
