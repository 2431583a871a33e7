"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

A text is normalised here: at every place the longest prefix that the model's compiled character map knows is
replaced, blanks are folded and escaped as the model asks, and each normalised byte keeps the place of the source bytes it
stands for. The model's segmentation then cuts the normalised bytes (its own normaliser is switched off, it sees them as they
are), and the pieces, whose lengths in normalised bytes are known, are projected back to source bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kohorta.llm.text import filled, narrow, slices
from kohorta.llm.tokens import tokenizer_file

ESCAPE = "▁".encode()
# Field numbers of the model file, kinds of pieces.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: The normaliser of a model that takes its input as it is: identity, no map, no dummy prefix, no folding, no escaping.
#: Behind a model's own one it takes its place, since a later field of a message wins.
AS_IT_IS = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"
RESULT = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (field number, value) pairs of a serialised message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at: at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over source bytes whose values point at replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4: 4 + size], "<u4").astype(np.int64)
        self.texts = compiled[4 + size:]

    def _offset(self, units):
        return (units >> 10) << ((units & 512) >> 6)

    def longest(self, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest known prefix at each place (0: none) and where its replacement stands; all
        places walk the trie together, a byte at a time."""
        length, value = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        alive, depth = np.arange(len(places)), 0
        node = np.full(len(places), self._offset(self.units[0]))
        while len(alive):
            inside = places[alive] + depth < len(raw)
            alive, node = alive[inside], node[inside]
            byte = raw[places[alive] + depth].astype(np.int64)
            child = node ^ byte
            known = child < len(self.units)
            unit = self.units[np.where(known, child, 0)]
            known &= (unit & (1 << 31 | 255)) == byte
            alive, unit, node = alive[known], unit[known], child[known] ^ self._offset(unit[known])
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def replacement(self, value: int) -> bytes:
        return self.texts[value: self.texts.index(b"\0", value)]


class Normalizer:
    """``normalizer(source)`` gives the normalised bytes and, for each of their boundaries, the source place."""

    def __init__(self, spec: bytes):
        found = dict(fields(spec))
        self.map = CharacterMap(found[2]) if found.get(2) else None
        self.prefix, self.fold, self.escape = (bool(found.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(source, np.uint8)
        out, begin = self._replaced(source, raw) if self.map else (raw, np.arange(len(raw), dtype=np.int64))
        if self.fold:
            blank = out == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            out, begin = out[keep], begin[keep]
        if not len(out):
            return b"", np.full(1, len(raw))
        if self.prefix:
            out, begin = np.concatenate([[np.uint8(32)], out]), np.concatenate([begin[:1], begin])
        mark = ESCAPE if self.escape else b" "
        written = out.tobytes().replace(b" ", mark)
        places = np.append(np.repeat(begin, np.where(out == 32, len(mark), 1)), len(raw))
        while self.fold and written.endswith(mark):  # the mark itself may stand in the source
            written = written[: -len(mark)]
            places = places[: len(written) + 1]
        return written, places

    def _replaced(self, source, raw):
        """Source bytes with the longest known prefixes replaced, from left to right."""
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        length, value = self.map.longest(raw, heads)
        at, parts, begins = 0, [], []
        for i in np.flatnonzero(length):
            place = int(heads[i])
            if place < at:
                continue
            text, size = self.map.replacement(int(value[i])), int(length[i])
            parts += [source[at:place], text]
            begins += [np.arange(at, place), np.full(len(text), place)]
            at = place + size
        parts.append(source[at:])
        begins.append(np.arange(at, len(source)))
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(begins)


class PieceModel:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer, spec, sizes, kinds = {}, b"", [], set()
        for number, value in fields(model):
            if number == PIECE:
                piece = dict(fields(value))
                kind = piece.get(3, NORMAL)
                kinds.add(kind)
                sizes.append({NORMAL: len(piece[1]), BYTE: 1}.get(kind, 0))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                spec = value
        if USER_DEFINED in kinds or trainer.get(24, 0) or BYTE not in kinds:
            raise ValueError("models need byte pieces, no user-defined pieces and white space in front of words")
        self.sizes, self.normalizer = np.array(sizes, np.int64), Normalizer(spec)
        self.segmenter = sentencepiece.SentencePieceProcessor(
            model_proto=model + bytes([NORMALIZER << 3 | 2, len(AS_IT_IS)]) + AS_IT_IS)

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Per text: ids without an end, and first and end source byte of every piece."""
        normal = [self.normalizer(t) for t in texts]
        found = self.segmenter.encode([n for n, _ in normal], num_threads=1)
        out = []
        for ids, (written, places) in zip(found, normal):
            bounds = np.concatenate([[0], np.cumsum(self.sizes[np.array(ids, np.int64)])])
            if bounds[-1] != len(written):
                raise RuntimeError("pieces do not cover the normalised text")
            at = places[bounds]
            out.append((ids, at[:-1], at[1:]))
        return out


_made: dict[str, PieceModel] = {}


def piece_model(name: str) -> PieceModel:
    """One model for each Python worker, kept between its tasks."""
    if name not in _made:
        with open(tokenizer_file(name), "rb") as file:
            _made[name] = PieceModel(file.read())
    return _made[name]


def _lists(parts, lengths, kind):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_pieces(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for every row of ``docs`` (doc_id, text).

    ids are those of the sentencepiece library for the whole text, with its end id if ``end``; piece i stands for the UTF-8
    bytes starts[i] to ends[i] of the text (a piece that only marks the text's beginning or end is empty there; where the
    character map writes several bytes for one prefix, the later ones start where it starts); decoded is the
    library's text for ids. A missing or empty text has no pieces but the end; rows without doc_id and
    repeated rows stay; other columns are left out, whatever their names; an empty table gives an empty result. Rows are
    independent, so nothing is shuffled; a task holds one slice of texts, or one longer text.
    """
    def run(batches):
        made = piece_model(model)
        stop = [made.library.eos_id()] if end else []
        for batch in slices(batches):
            raw = filled(batch.column("text")).cast(pa.large_binary()).to_pylist()
            found = made.encode(raw)
            ids = [f[0] + stop for f in found]
            close = [np.full(len(stop), len(r)) for r in raw]
            lengths = [len(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists([np.array(i, np.int64) for i in ids], lengths, np.int32),
                 _lists([x for f, c in zip(found, close) for x in (f[1], c)], lengths, np.int32),
                 _lists([x for f, c in zip(found, close) for x in (f[2], c)], lengths, np.int32),
                 pa.array(made.library.decode(ids, num_threads=1), pa.string())],
                ["doc_id", "ids", "starts", "ends", "decoded"])
    return narrow(docs, doc_id="bigint", text="string").mapInArrow(run, RESULT)
