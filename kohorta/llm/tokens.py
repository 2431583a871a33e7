"""Token ids of whole texts, through a cache of chunks that a tokenizer encodes independently.

``leading`` suits byte-level BPE whose pattern binds one blank to the following word: the text is cut before
a blank or line feed between two other characters, where no token can span. ``dropped`` suits byte-level BPE behind a
normalizer that lower-cases and a pattern that drops white space: the text is cut at blanks and line feeds. ``whole`` encodes
each text as it is. The ids are those of the whole text in every case. A comma or point that ends a chunk behind a
letter is a token of its own and is cut off too; a chunk of plain letters is one word of the tokenizer's pattern and goes
straight to its BPE model. The cache keeps two generations of a fixed number of chunks and forgets the older one.
"""

from __future__ import annotations

import os
import re
from array import array

CACHE_CHUNKS, CACHED_LENGTH = 700_000, 64
#: White space that is neither a blank nor a line feed, and the mark of a chunk that stands for itself.
ODD = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")
EXACT = "\x00"
#: Byte-level BPE writes a byte as the character of that code where it is printable, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TEXT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_made: dict = {}


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, name: str, chunks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.tokenizer.encode_special_tokens = True  # in a text they are ordinary text
        self.model, self.lower = self.tokenizer.model, chunks == "dropped"
        self.cut = {"leading": self._leading, "dropped": self._dropped, "whole": lambda text: [EXACT + text]}[chunks]
        self.blank, self.words = ("Ġ" if chunks == "leading" else ""), chunks != "whole"
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _leading(text):
        """A chunk stands for itself behind a blank, or for itself if it begins with a line feed or the mark."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD.search(text):
            return [EXACT + c for c in BETWEEN.split(text)]
        cut = text.replace("\n", " \n").split(" ")
        cut[0] = EXACT + cut[0]
        return cut

    @staticmethod
    def _dropped(text):
        return text.replace("\n", " ").split(" ")

    def _full(self, chunk):
        if self.lower or chunk[:1] == "\n":
            return chunk
        return chunk[1:] if chunk[:1] == EXACT else " " + chunk

    def _encode(self, chunks):
        """New chunks into the cache: letters by the model alone, others by the whole tokenizer."""
        known, tokenize, blank, others = self.cache, self.model.tokenize, self.blank, []
        for c in chunks:
            if self.words and c.isalpha() and (c.isascii() or max(c) <= "\xff") and (not self.lower or c == c.lower()):
                written = c if c.isascii() else c.encode().decode("latin-1").translate(BYTE_TEXT)
                known[c] = array("I", [t.id for t in tokenize(blank + written)]).tobytes()
            else:
                others.append(c)
        found = self.tokenizer.encode_batch_fast([self._full(c) for c in others], add_special_tokens=False)
        for c, e in zip(others, found):
            known[c] = array("I", e.ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache, self.older = {}, self.cache
        known, older, new, parts = self.cache, self.older.get, set(), []
        missing = set().union(*cut).difference(known)
        for c in missing:
            if (ids := older(c)) is not None:
                known[c] = ids
                continue
            word, end = c, c[-1:]
            if self.words and (end == "," or end == ".") and c[-2:-1].isalpha() and c[-2:-1].lower().isalpha():
                word, end = c[:-1], end if self.lower else EXACT + end
                new.add(end)
            else:
                end = ""
            if self.lower and word.isalpha() and max(word) <= "\xff":
                word = word.lower()
            new.add(word)
            if word != c:
                parts.append((c, word, end))
        fresh = []
        for c in new:
            if c not in known:
                if (ids := older(c)) is not None:
                    known[c] = ids
                else:
                    fresh.append(c)
        self._encode(fresh)
        for c, word, end in parts:
            known[c] = known[word] + known[end] if end else known[word]
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for long in [c for c in {*fresh, *missing} if len(c) > CACHED_LENGTH]:
            known.pop(long, None)
        return out


def encoder(name: str, chunks: str) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    if (name, chunks) not in _made:
        _made[name, chunks] = Encoder(name, chunks)
    return _made[name, chunks]
