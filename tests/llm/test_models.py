import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from kohorta.llm import langid, ngram_lm, pii


def test_lm_base_scores(tricky, texts):
    got = ngram_lm.interpolated_scores(tricky, text_bytes_per_bucket=5000).collect()
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in texts]
    fold = {d: zlib.crc32(str(d).encode()) % 5 if d is not None else None for d, _ in texts}
    counts = Counter(w for d, ws in tokens if fold[d] not in (1, None) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, fold[d] == 1, len(ws), sum(counts[w] > 0 for w in ws), n, round(
        sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in tokens)
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_counts_and_probabilities_in_small_chunks(spark, monkeypatch):
    """Any cut into chunks and buckets gives the same scores, and they are those of the mixture written out."""
    rows = [(i, "a b a c a b d"[: 1 + 2 * (i % 7)] + " e" * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = {}
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda cells, floor, iterations=0: held.setdefault("w", {
        "w3": ngram_lm.np.r_[0.0, ngram_lm.np.full(ngram_lm.FREQUENCIES - 1, 0.5)],
        "w2": ngram_lm.np.r_[0.0, ngram_lm.np.full(ngram_lm.FREQUENCIES - 1, 0.4)], "w1": ngram_lm.np.array([0.9])}))
    got = {r.doc_id: r.score for r in ngram_lm.interpolated_scores(df, text_bytes_per_bucket=100).collect()}
    learned = [["<", "<", *t.split(), ">"] for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    one, two, three, c1, c2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for w in learned:
        for i in range(2, len(w)):
            one[w[i]] += 1
            two[w[i - 1], w[i]] += 1
            three[w[i - 2], w[i - 1], w[i]] += 1
            c1[w[i - 1]] += 1
            c2[w[i - 2], w[i - 1]] += 1
    n, v = sum(one.values()), len(one)
    for d, t in rows:
        w, total = ["<", "<", *t.split(), ">"], 0.0
        for i in range(2, len(w)):
            p = 0.9 * one[w[i]] / n + 0.1 / (v + 1)
            if c1[w[i - 1]]:
                p = 0.4 * two[w[i - 1], w[i]] / c1[w[i - 1]] + 0.6 * p
            if c2[w[i - 2], w[i - 1]]:
                p = 0.5 * three[w[i - 2], w[i - 1], w[i]] / c2[w[i - 2], w[i - 1]] + 0.5 * p
            total += math.log10(p)
        assert got[d] == pytest.approx(total, abs=1e-9)


def test_lm_weights_raise_the_held_out_likelihood(spark):
    cells = spark.createDataFrame([(3, 4, 5, 9, 30, 50), (3, 4, 0, 9, 30, 20), (0, 2, 0, 0, 12, 7), (3, 2, 0, 0, 0, 4)],
                                  "b3 int, b2 int, g3 int, g2 int, g1 int, n long")
    rows = [tuple(r) for r in cells.collect()]

    def likelihood(w):
        total = 0.0
        for b3, b2, g3, g2, g1, n in rows:
            f3, f2, f1 = (2.0 ** ((1 - g) / ngram_lm.STEPS) if g else 0.0 for g in (g3, g2, g1))
            p = w["w1"][0] * f1 + (1 - w["w1"][0]) * 0.001
            p = w["w2"][b2] * f2 + (1 - w["w2"][b2]) * p
            total += n * math.log(w["w3"][b3] * f3 + (1 - w["w3"][b3]) * p)
        return total

    steps = [likelihood(ngram_lm.learn_weights(cells, 0.001, i)) for i in (1, 3, 8)]
    assert steps[0] <= steps[1] <= steps[2]


def test_lm_keys_travel_as_steps():
    """Keys of a chunk come back as they were, and cost little more than their steps, which the number of keys makes short."""
    np = ngram_lm.np
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 600_000, dtype=np.uint64)
    keys = np.unique(np.concatenate([ngram_lm._keyed(hashes[i::3], i + 1) for i in range(3)]))
    cuts = np.concatenate([[0], np.searchsorted(keys, np.arange(1, 64, dtype=np.uint64) << np.uint64(58)), [len(keys)]])
    blobs = [ngram_lm._pack_keys(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    assert np.array_equal(np.concatenate([ngram_lm._unpack_keys(b) for b in blobs]), keys)
    old = sum(len(ngram_lm._pack(keys[a:b])) for a, b in zip(cuts[:-1], cuts[1:]))
    assert sum(map(len, blobs)) < 0.95 * old
    assert len(ngram_lm._unpack_keys(ngram_lm._pack_keys(keys[:0]))) == 0


def test_lm_deleted_counts_return_where_they_are_read():
    """Two chunks ask for one bucket: what the other deletes goes back for the keys that a chunk deletes itself."""
    np, pa = ngram_lm.np, ngram_lm.pa
    keys = np.sort(ngram_lm._keyed(np.arange(1, 5, dtype=np.uint64), 3))
    counts = [([3, 1, 2, 0], [2, 0, 1, 0]), ([4, 5, 0, 6], [1, 2, 0, 3])]
    sent = pa.table({"bucket": pa.array([0, 0], pa.int32()), "part": pa.array([0, 1], pa.int32()), "seq": pa.array([0, 0], pa.int32()),
                     "keys": [ngram_lm._pack_keys(keys)] * 2,
                     **{c: [ngram_lm._pack(np.array(x[i])) for x in counts] for i, c in enumerate(("learned", "deleted"))}})
    back = ngram_lm._add_up(sent)
    numbers = {c: [ngram_lm._unpack(b).tolist() for b in back.column(c).to_pylist()] for c in ("learned", "deleted")}
    assert numbers == {"learned": [[4, 5, 0, 6], [3, 1, 2, 0]], "deleted": [[1, 0, 0, 0], [2, 0, 0, 0]]}


def test_words_are_hashed_as_split(texts):
    """Equal hashes are equal words, text by text, also in a slice, with missing texts and texts that touch."""
    np, pa = ngram_lm.np, ngram_lm.pa
    given = [None, "skipped", "ab", "cd ab", "", None, "\x0bAB\tcd\x85x ", " ", "w" * 7, "w" * 8, "w" * 9, "w" * 64, "w" * 65, "W" * 65 + " a\x00 a",
             *[t for _, t in texts], None, ""]
    rows = pa.array(given)[2:]
    hashes, starts = ngram_lm.word_hashes(rows)
    words = [(t or "").encode().lower().split() for t in given[2:]]
    assert starts.tolist() == np.cumsum([0, *map(len, words)]).tolist()
    flat = [w for own in words for w in own]
    assert len(set(zip(hashes.tolist(), flat))) == len(set(flat)) == len(set(hashes.tolist()))
    for none in ([], [None], ["", " "]):
        assert [x.tolist() for x in ngram_lm.word_hashes(pa.array(none, pa.string()))] == [[], [0] * (len(none) + 1)]


def test_distinct_keys_are_those_of_a_full_sort():
    np = ngram_lm.np
    rng = np.random.default_rng(1)
    top = np.uint64((1 << 64) - 1)
    for keys in (rng.integers(0, 1 << 63, 5_000, dtype=np.uint64), rng.integers(0, 50, 5_000, dtype=np.uint64), np.zeros(3, np.uint64),
                 (rng.integers(0, 4, 5_000, dtype=np.uint64) << np.uint64(62)) + rng.integers(0, 900, 5_000, dtype=np.uint64),
                 top - rng.integers(0, 9, 700, dtype=np.uint64), np.array([0, top, 0], np.uint64), np.array([7], np.uint64), np.zeros(0, np.uint64)):
        for got, want in zip(ngram_lm.distinct_keys(keys), np.unique(keys, return_inverse=True)):
            assert np.array_equal(got, want)


def test_lm_chunks_cost_less_than_a_loop_over_words():
    """CPU seconds: making a chunk, hashes and sequences, takes less than hashing its words one by one, twice."""
    rng = random.Random(3)
    text = " ".join("%x" % rng.randrange(1 << rng.randrange(4, 40)) for _ in range(200_000))

    def seconds(work):
        spent = []
        for _ in range(3):
            start = time.process_time()
            work()
            spent.append(time.process_time() - start)
        return min(spent)
    loop = seconds(lambda: ngram_lm.np.fromiter(map(ngram_lm.xxhash.xxh3_64_intdigest, text.encode().lower().split()), "u8"))
    assert seconds(lambda: ngram_lm.Chunk(ngram_lm.pa.array([text]))) < 2 * loop


def test_lm_of_nothing(nothing):
    assert ngram_lm.interpolated_scores(nothing).collect() == []


def test_language(spark):
    words = {"en": "the house and river with those", "de": "das haus und der fluß mit über", "fr": "la maison et l'été avec où"}
    rows = [(i, " ".join(words[k].split()[(i + j) % 6] for j in range(3 + i % 9)), k)
            for i, k in enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 !? 3", "de"), (503, "house and the river", None), (503, None, None)]
    got = langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    out = [(d, k) for d, _, k in rows if d < 500 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(by_id[d].held_out for d, _ in out)
    assert sum(by_id[d].lang_pred == k for d, k in out) >= 0.95 * len(out)
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (500, 501, 502))
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}


def test_language_of_nothing_and_unlabelled(spark, nothing, tricky):
    assert langid.identify_language(nothing).collect() == []
    none = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify_language(none).collect()] == [("und", 0.0)]
    assert langid.identify_language(tricky).count() == tricky.count()


def test_temperature_and_leader():
    rows = [(langid.np.array([i % 2]), langid.np.array([1.0]), i % 2) for i in range(40)]
    weights = langid.follow_the_leader(rows, 2)
    assert weights[0, 0] > 0 > weights[1, 0] and weights[1, 1] > 0 and not weights[:, 2:].any()
    outputs = [langid.np.array([4.0, 0.0])] * 10
    assert langid.best_temperature(outputs, [0] * 7 + [1] * 3) == pytest.approx(4 / math.log(7 / 3), rel=0.05)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            keep = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if keep:
                found.append((m.start(), m.end(), list(PATTERNS).index(kind)))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = pii.np.random.default_rng(1)
    pieces = ["a@b.c", "x.y@z", "@", "1.2.3.4", "300.1.1.1", "+1 (212) 555-1234", "4111 1111 1111 1111", "4111111111111111",
              "+", "12-34", " ", "\n", "é", ".", "--", "0001.2.3.255", "_d@e.f"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        assert pii.base_spans(text) == brute_spans(text), repr(text)
    assert len(pii.base_spans("a" * 200_000 + "@" * 1000)) == 0


def test_personal_data(spark, tricky, texts, nothing):
    rows = [(i, f"call +1 ({200 + i}) 555-{1000 + i} or mail u{i}@mail.example.com from 10.0.{i}.7 version {i}.0.") for i in range(60)]
    rows += [(100, "card 4111.1111.1111.1111 here"), (101, "4111111111111111"), (102, None), (103, "nothing here 2.0.")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans = brute_spans(text or "")
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[2] == k for s in spans) for k in range(4)]
        base = [f"{list(PATTERNS)[k]}:{a}:{b}" for a, b, k in spans]
        assert got[i].base_sha256 == pii.hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(",")) | {""}
    assert got[103].spans == "" and got[102].spans == ""
    assert pii.personal_data(nothing).collect() == []
    assert pii.personal_data(tricky).count() == len(texts)


def test_field_gradient_and_best_path():
    """The gradient is that of the likelihood; the chosen spans are the best of all ways to cut a short zone."""
    zone, spans = "id +1 (212) 555-1234 a@b.cd", [(3, 20, 3), (21, 27, 0)]
    field = pii.SemiMarkovField()
    ready = field._labelled(zone, spans)
    if ready is None:
        spans = spans[:1]
        ready = field._labelled(zone, spans)
    rng = pii.np.random.default_rng(2)
    field.weights = rng.normal(0, 0.1, field.weights.shape)
    field.steps = rng.normal(0, 0.1, field.steps.shape)
    value, expected, steps = field.gradient(ready)
    assert value < 0
    s, kind = ready[3][0]
    feature, eps = int(ready[2][s][1]), 1e-5
    hits = [(i, int((row == feature).sum())) for i, row in enumerate(ready[2]) if (row == feature).any()]
    field.weights[kind, feature] += eps
    change = (field.gradient(ready)[0] - value) / eps
    assert change == pytest.approx(-sum(expected[i, kind] * n for i, n in hits), abs=1e-3)
    field.weights[kind, feature] -= eps
    field.steps[0, 1] += eps
    assert (field.gradient(ready)[0] - value) / eps == pytest.approx(-steps[0, 1], abs=1e-3)
    borders, segments, rows = pii.candidates(zone)
    scores = field._scores(rows) - pii.MARGIN + 3

    def best(i, before):
        if i == len(borders) - 1:
            return 0.0
        ways = [field.steps[before, 0] + best(i + 1, 0)]
        for s, (a, b) in enumerate(segments):
            if a == i:
                ways += [field.steps[before, k + 1] + scores[s, k] + best(b, k + 1) for k in range(4)]
        return max(ways)

    field.weights[:, pii._hash("bias")] += 3
    chosen = field.best(zone)
    place = {b: i for i, b in enumerate(borders)}
    total, j, before = 0.0, 0, 0
    for a, b, k in chosen:
        for _ in range(place[a] - j):
            total, before = total + field.steps[before, 0], 0
        total += field.steps[before, k + 1] + field._scores(rows)[segments.index((place[a], place[b])), k] - pii.MARGIN
        before, j = k + 1, place[b]
    for _ in range(len(borders) - 1 - j):
        total, before = total + field.steps[before, 0], 0
    assert total == pytest.approx(best(0, 0))
