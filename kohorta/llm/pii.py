"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give base spans, which always stay. The random field scores whole candidate segments (shape, digits, check
sums, neighbours) and chooses boundaries and types jointly, by dynamic programming over segments of bounded length, wherever no
base span stands. It is fitted by maximum likelihood on the base spans of a bounded sample of texts and on copies of
them that the patterns miss (no leading plus, other separators), so that what it adds looks like personal data without having its
exact form. Only zones with a digit or an @ can hold a candidate; all other characters are outside by definition, which lets
the zones of a text be solved one by one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import filled, narrow, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMERIC = re.compile(r"[+0-9][+0-9 ().\-]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S*")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
WEIGHT_BITS, FEATURES, LONGEST, LONGEST_ATOM, LEAST = 14, 14, 18, 64, 7
#: Log-odds that a segment must have over leaving its characters outside.
MARGIN = 2.0


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-1][::2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else done
        if found:
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns, by start and kind; leftmost and non-overlapping within a kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    for region in NUMERIC.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((*m.span(), 1))
        for m in CARD.finditer(text, a, b):
            digits = only_digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        for m in PHONE.finditer(text, a, b):
            if 9 <= len(only_digits(m.group())) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << WEIGHT_BITS) - 1)


def segment_features(text: str, a: int, b: int) -> list[int]:
    """Features of the whole span a:b of a zone."""
    span = text[a:b]
    shape = re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", span))
    digits = only_digits(span)
    parts = span.split(".")
    left, right = text[a - 1: a] or "^", text[b: b + 1] or "$"
    names = ["bias", "shape " + shape.replace("+", "")[:24], "runs " + re.sub(r"(.)\1+", r"\1", shape)[:24],
             f"digits {len(digits)}", f"letters {min(9, sum(c.isalpha() for c in span) // 4)}", f"length {min(12, len(span) // 3)}",
             f"at {span.count('@')} {min(3, len(parts) - 1) if '@' in span else ''}", f"first {shape[0]}", f"last {shape[-1]}",
             "left " + ("a" if left.isalpha() else "9" if left.isdigit() else left),
             "right " + ("a" if right.isalpha() else "9" if right.isdigit() else right),
             f"octets {len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
             f"luhn {12 <= len(digits) <= 19 and luhn(digits)}", f"groups {len(re.findall('[0-9]+', span))}"]
    return [_hash(n) for n in names]


def candidates(text: str) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Borders of the zone's atoms, candidate segments (atom to atom) and their features."""
    borders = [0, *(m.end() for m in ATOM.finditer(text))]
    segments, rows = [], []
    for i in range(len(borders) - 1):
        if not (text[borders[i]].isascii() and text[borders[i]].isalnum() or text[borders[i]] in "+("):
            continue
        for j in range(i + 1, min(len(borders) - 1, i + LONGEST) + 1):
            a, b = borders[i], borders[j]
            if b - a > 4 * LONGEST_ATOM:
                break
            if b - a < LEAST or not (text[b - 1].isascii() and text[b - 1].isalnum()) or not MARK.search(text, a, b):
                continue
            if len(only_digits(text[a:b])) < 4 and "@" not in text[a:b]:
                continue
            segments.append((i, j))
            rows.append(segment_features(text, a, b))
    return borders, segments, np.array(rows, np.int64).reshape(len(rows), FEATURES)


class SemiMarkovField:
    """Segments of KINDS among single outside atoms; the score of a segment is a sum of feature weights and of the step
    from the kind before it."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), 1 << WEIGHT_BITS))
        self.steps = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _scores(self, rows):
        return self.weights[:, rows].sum(axis=2).T if len(rows) else np.zeros((0, len(KINDS)))

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """The likeliest spans (start, end, kind) of a zone."""
        borders, segments, rows = candidates(text)
        if not segments:
            return []
        scores, n, k = self._scores(rows) - MARGIN, len(borders), len(KINDS) + 1
        best, back = np.full((n, k), -np.inf), {}
        best[0, 0] = 0.0
        ending: dict[int, list[int]] = {}
        for s, (_, j) in enumerate(segments):
            ending.setdefault(j, []).append(s)
        for j in range(1, n):
            came = best[j - 1] + self.steps[:, 0]
            best[j, 0], back[j, 0] = came.max(), (j - 1, int(came.argmax()), None)
            for s in ending.get(j, ()):
                i = segments[s][0]
                for kind in range(1, k):
                    came = best[i] + self.steps[:, kind]
                    value = came.max() + scores[s, kind - 1]
                    if value > best[j, kind]:
                        best[j, kind], back[j, kind] = value, (i, int(came.argmax()), s)
        j, kind, found = n - 1, int(best[n - 1].argmax()), []
        while j:
            i, before, s = back[j, kind]
            if s is not None:
                found.append((borders[i], borders[j], kind - 1))
            j, kind = i, before
        return found[::-1]

    def gradient(self, zone) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the labelled zone, and how far the expected segments and steps are from the labelled ones."""
        n, segments, rows, gold, gold_steps = zone
        scores, k = self._scores(rows), len(KINDS) + 1
        alpha, beta = np.full((n, k), -np.inf), np.full((n, k), -np.inf)
        alpha[0, 0], beta[n - 1] = 0.0, 0.0
        starts, ends = {}, {}
        for s, (i, j) in enumerate(segments):
            starts.setdefault(i, []).append(s)
            ends.setdefault(j, []).append(s)
        add = np.logaddexp.reduce
        for j in range(1, n):
            alpha[j, 0] = add(alpha[j - 1] + self.steps[:, 0])
            for s in ends.get(j, ()):
                came = add(alpha[segments[s][0]][:, None] + self.steps[:, 1:], axis=0) + scores[s]
                alpha[j, 1:] = np.logaddexp(alpha[j, 1:], came)
        for i in range(n - 2, -1, -1):
            beta[i] = self.steps[:, 0] + beta[i + 1, 0]
            for s in starts.get(i, ()):
                beta[i] = np.logaddexp(beta[i], add(self.steps[:, 1:] + scores[s] + beta[segments[s][1], 1:], axis=1))
        total = add(alpha[n - 1])
        expected, steps = np.zeros_like(scores), np.zeros_like(self.steps)
        for s, (i, j) in enumerate(segments):
            p = np.exp(alpha[i][:, None] + self.steps[:, 1:] + scores[s] + beta[j, 1:] - total)
            expected[s] = p.sum(axis=0)
            steps[:, 1:] += p
        for j in range(1, n):
            steps[:, 0] += np.exp(alpha[j - 1] + self.steps[:, 0] + beta[j, 0] - total)
        own = sum(scores[s, kind] for s, kind in gold) + (gold_steps * self.steps).sum()
        for s, kind in gold:
            expected[s, kind] -= 1
        return own - total, expected, steps - gold_steps

    def fit(self, zones: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3):
        """Stochastic gradient ascent on the likelihood of labelled zones, in the given order."""
        ready = [z for z in (self._labelled(text, spans) for text, spans in zones) if z]
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for zone in ready:
                _, expected, steps = self.gradient(zone)
                for s, kind in np.argwhere(np.abs(expected) > 1e-4):
                    self.weights[kind, zone[2][s]] -= step * expected[s, kind]
                self.steps -= step * steps
            self.weights *= 1 - decay
        return self

    @staticmethod
    def _labelled(text, spans):
        borders, segments, rows = candidates(text)
        place, at = {b: i for i, b in enumerate(borders)}, {s: i for i, s in enumerate(segments)}
        gold, steps, j, before = [], np.zeros((len(KINDS) + 1, len(KINDS) + 1)), 0, 0
        for a, b, kind in spans:
            segment = (place.get(a), place.get(b))
            if segment not in at or segment[0] < j:
                return None
            outside = segment[0] - j
            steps[before, 0] += outside > 0
            steps[0, 0] += max(0, outside - 1)
            before = 0 if outside else before
            steps[before, kind + 1] += 1
            gold.append((at[segment], kind))
            before, j = kind + 1, segment[1]
        outside = len(borders) - 1 - j
        steps[before, 0] += outside > 0
        steps[0, 0] += max(0, outside - 1)
        return (len(borders), segments, rows, gold, steps) if segments else None


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @; those one blank apart are one zone."""
    start = end = -1
    mark = MARK.search(text)
    while mark:
        a = mark.start()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        if end >= 0 and not (a == end + 1 and text[end] == " "):
            yield start, end
            start = a
        elif end < 0:
            start = a
        end = TOKEN.match(text, mark.start()).end()
        mark = MARK.search(text, end)
    if end >= 0:
        yield start, end


def varied(text: str, spans):
    """Copies of a labelled zone that the patterns miss: a phone without its plus, a card number with points."""
    for n, (a, b, kind) in enumerate(spans):
        if len(spans) == 1 and kind == 3:
            yield text[:a] + text[a + 1:], [(a, b - 1, 3)]
        if len(spans) == 1 and kind == 2 and b - a == 16:
            span = ".".join(text[a + i: a + i + 4] for i in range(0, 16, 4))
            yield text[:a] + span + text[b:], [(a, a + len(span), 2)]


def _sample_zones(per_text):
    def run(batches):
        for batch in slices(batches):
            texts, starts, ends, kinds = [], [], [], []
            for text in filled(batch.column("text")).to_pylist():
                spans, taken, end = base_spans(text), 0, -1
                for a, b in zones(text):
                    own = [(s - a, e - a, k) for s, e, k in spans if a <= s and e <= b]
                    if taken == per_text or b - a > 400:
                        continue
                    taken += 1
                    texts.append(text[a:b])
                    starts.append([s for s, _, _ in own])
                    ends.append([e for _, e, _ in own])
                    kinds.append([k for _, _, k in own])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(starts, ints), pa.array(ends, ints),
                                              pa.array(kinds, ints)], ["zone", "starts", "ends", "kinds"])
    return run


def learn_field(documents: DataFrame, sample_rows: int = 3000, zones_per_row: int = 8) -> SemiMarkovField:
    """Fit on at most ``zones_per_row`` zones of each of the ``sample_rows`` rows with the smallest hashes of their ids."""
    docs = narrow(documents, doc_id="bigint", text="string").withColumn("order", F.xxhash64("doc_id", F.lit(29)))
    last = docs.select("order").orderBy("order").limit(sample_rows).agg(F.max("order")).first()[0]
    field = SemiMarkovField()
    if last is None:
        return field
    found = docs.where(F.col("order") <= last).select("text").mapInArrow(
        _sample_zones(zones_per_row), "zone string, starts array<int>, ends array<int>, kinds array<int>").toArrow().to_pylist()
    rows = sorted({(r["zone"], tuple(zip(r["starts"], r["ends"], r["kinds"]))) for r in found},
                  key=lambda r: hashlib.md5(r[0].encode("utf-8", "surrogatepass")).digest())[: sample_rows]
    labelled = [(z, list(spans)) for z, spans in rows]
    return field.fit([x for z, s in labelled for x in [(z, s), *varied(z, s)]])


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the field adds between them."""
    base, added = base_spans(text), []
    starts = [s[0] for s in base]
    ends = np.maximum.accumulate([s[1] for s in base]).tolist() if base else []
    at = 0
    for a, b in zones(text):
        while at < len(base) and ends[at] <= a:
            at += 1
        inner, here = at, a
        while here < b:
            while inner < len(base) and ends[inner] <= here:
                inner += 1
            stop = min(b, max(here, starts[inner])) if inner < len(base) else b
            if stop > here:
                added += [(here + s, here + e, k) for s, e, k in field.best(text[here:stop])]
            here = max(stop, min(b, ends[inner])) if inner < len(base) else b
    return base, added


def _named(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _find(field):
    def run(batches):
        for batch in slices(batches):
            out = []
            for text in filled(batch.column("text")).to_pylist():
                base, added = find_spans(text, field)
                counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(_named(base).encode()).hexdigest(), _named(base + added), len(added)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out), types)]],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
    return run


def personal_data(documents: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """Personal data of every row of documents (doc_id, text): numbers of base spans by kind, the digest of the base spans,
    all spans, and n_added, how many of them the field added.

    Places are code points, ends exclusive. A missing or empty text has no spans; repeated rows and rows without doc_id are
    each searched; an empty table gives an empty result.
    """
    docs = narrow(documents, doc_id="bigint", text="string")
    return docs.mapInArrow(_find(learn_field(docs, sample_rows)),
                           "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                           "n_added long")
