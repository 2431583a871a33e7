import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kohorta.llm import tokens
from kohorta.llm.packing import configurations, knapsack, pack_sequences
from kohorta.llm.token_files import SequenceFile, read_token_files, write_token_files
from kohorta.session import scratch_path

SETS = [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "whole")]


def direct(name):
    t = Tokenizer.from_file(tokens.tokenizer_file(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,chunks", SETS)
def test_chunks_give_the_ids_of_the_whole_text(name, chunks, texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    rng, alphabet = random.Random(3), "abÉßİΣñ.,'!? \n\t\r\xa0\x1c\x85 ́中19sStT<|endoftext|>-_\x00 ,  "
    own, encode = direct(name), tokens.Encoder(name, chunks)
    for _ in range(60):
        batch = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        batch += [t or "" for _, t in rng.sample(texts, 2)]
        for text, ids in zip(batch, encode(batch)):
            assert np.frombuffer(ids, "<u4").tolist() == own(text), repr(text)


def test_packing(tricky, texts):
    got = pack_sequences(tricky, capacity=128).collect()
    own, want = direct("word_bpe_49k.json"), []
    for doc, text in texts:
        ids = own(text) + [1]
        want += [(doc, p, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 128))
                 for x in [ids[a: a + 128]]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= -(-sum(r.length for r in got) // 128) + 1


def test_packing_nothing(nothing):
    assert pack_sequences(nothing).collect() == []


def test_knapsack_and_configurations():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 30), 5)))
        values = np.array([rng.random() for _ in lengths])
        best = [0.0]
        for room in range(1, 31):
            best.append(max([best[-1], *(best[room - x] + v for x, v in zip(lengths, values) if x <= room)]))
        value, chosen = knapsack(lengths, values, 30)
        assert value == pytest.approx(best[30]) and sum(lengths[i] * n for i, n in chosen.items()) <= 30
        counts = [rng.randint(1, 40) for _ in lengths]
        plan, bound = configurations(lengths, counts, 30, rounds=40)
        covered = {}
        for config, times in plan:
            assert times > 0 and sum(k * n for k, n in config.items()) <= 30
            for k, n in config.items():
                covered[k] = covered.get(k, 0) + n * times
        assert covered == dict(zip(lengths.tolist(), counts))
        assert bound <= sum(t for _, t in plan) <= 1.3 * bound + 2
    assert configurations([], [], 10) == ([], 0)


def test_token_files_round_trip(spark, tricky, texts):
    folder = scratch_path(spark, "files")
    manifest = write_token_files(tricky, folder, length=64)
    own = direct("byte_bpe_50k.json")
    rows = sorted(((doc, own(text) + [0]) for doc, text in texts), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start, stream = set(), 0, []
    for doc, ids in rows:
        want.add((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    assert {tuple(r) for r in read_token_files(manifest).collect()} == want
    back = []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        shard = SequenceFile(r.path)
        own_ids = []
        for i in range(len(shard)):
            assert len(shard.ids(i)) == len(shard.mask(i)) == 64
            own_ids += shard.ids(i)[shard.mask(i)].tolist()
        assert own_ids == shard.all_ids().tolist()
        back += own_ids
    assert back == stream


def test_token_files_of_nothing(spark, nothing):
    manifest = write_token_files(nothing, scratch_path(spark, "files"))
    assert manifest.count() == 0 and read_token_files(manifest).collect() == []


def test_packing_of_many_lengths_comes_close_to_the_bound():
    """Mean lengths that fill no sequence evenly: triples and pairs must be mixed over all lengths."""
    lengths = np.arange(1000, 2001)
    counts = np.random.default_rng(3).integers(150, 250, len(lengths))
    plan, bound = configurations(lengths, counts, 4096)
    covered = {}
    for config, times in plan:
        assert times > 0 and sum(k * n for k, n in config.items()) <= 4096
        for k, n in config.items():
            covered[k] = covered.get(k, 0) + n * times
    assert covered == dict(zip(lengths.tolist(), counts.tolist()))
    assert bound > lengths @ counts / 4096 and sum(n for _, n in plan) <= 1.01 * bound
