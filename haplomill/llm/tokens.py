"""Token ids of whole texts by the tokenizers library, cached by stretches that the pre-tokenizer never joins.

A byte-level pre-tokenizer of this family cuts a text into words with the blank before them, and into what lies
between words. Both are looked up, so that a distinct word is merged once. What lies between is cut by the
pre-tokenizer's own pattern; that gives the same cuts as in the whole text, as a blank before a word goes to the word
and a line feed before one stands alone. A text with other white space, numerals that aren't digits, or an
apostrophe whose meaning depends on what stands before it, goes to the library whole.

Most texts need no pattern at all. Before a blank that is followed by anything but white space the pre-tokenizer always
cuts, and a single line feed between other characters stands alone; texts whose blanks and line feeds are all of these
kinds are split there and looked up by what lies between.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import regex

STRETCH = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+|(?:[\W\d_](?<![ \n])|[ \n](?![^\W\d_]))+|\n")


def _odd() -> frozenset[str]:
    """White space but blank and line feed, and what `re` takes for a word character though it is neither letter nor digit."""
    space = lambda c: c not in " \n" and (c.isspace() or c in "\x1c\x1d\x1e\x1f\x85")
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if space(c) or c.isnumeric() and not c.isalpha() and not c.isdecimal())


ODD = _odd()
#: An apostrophe that may or may not begin a word's ending.
LOOSE = re.compile(r"(?<![^\W\d_])'(?=[stmdrvl])")


def odd(text: str) -> bool:
    return not ODD.isdisjoint(text) or "'" in text and LOOSE.search(text) is not None


#: How this family of byte-level tokenizers cuts a text before merging (fixed by the vocabulary file).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte to letter, as byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
LETTER_BLANK = chr(BYTE_LETTERS[32])
#: Marks that stand alone when they end a word.
MARKS = frozenset(".,;:!?)")


class Chunks(dict):
    """Ids by chunk of what `ids` gives for `lead` and the chunk, in two generations; None where a chunk begins with white space."""

    def __init__(self, merge, ids, lead: str, size: int, longest: int = 40):
        self.merge, self.ids, self.lead, self.size, self.longest, self.old = merge, ids, lead, size, longest, {}
        self.marks = {m: merge(m) for m in MARKS}

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self.merge(self.lead + chunk)
            elif not chunk or chunk[0].isspace():
                return None
            elif chunk[-1] in MARKS and chunk[:-1].isalpha():
                ids = self[chunk[:-1]] + self.marks[chunk[-1]]
            else:
                ids = self.ids(self.lead + chunk)
        if len(chunk) <= self.longest:  # longer ones seldom come again
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """encode(texts) gives a bytes object of little-endian ids for each text; null counts as empty.

    Special strings inside a text are ordinary text. Memory is bounded by cache_size stretches in each of two generations.
    """

    def __init__(self, path: str, cache_size: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.size = cache_size
        self.chunks, self.starts = Chunks(self._merge, self._apart, " ", cache_size), Chunks(self._merge, self._apart, "", cache_size // 4)
        self.feed = self._merge("\n")

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _merge(self, piece: str) -> bytes:
        """The library's merges over one pre-token."""
        letters = piece.replace(" ", LETTER_BLANK) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.cache.get(piece) or self.old.get(piece) or self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.size // 4:
                self.pieces.clear()
            ids = self.pieces[piece] = self._merge(piece)
        return ids

    def _stretch(self, text: str) -> bytes:
        return self._merge(text) if text[-1].isalpha() else b"".join(map(self._piece, PRETOKEN.findall(text)))

    def _apart(self, text: str) -> bytes:
        return b"".join(map(self._piece, PRETOKEN.findall(text))) if ODD.isdisjoint(text) else self._library([text])[0]

    def _blanks(self, text: str) -> bytes | None:
        """The ids of a text split at line feeds and blanks; None if one of them lies beside other white space or at an end."""
        get, start, out = self.chunks.__getitem__, self.starts.__getitem__, []
        try:
            for line in text.split("\n"):
                chunks = iter(line.split(" "))
                out.append(start(next(chunks)) + b"".join(map(get, chunks)))
        except TypeError:  # a chunk is empty or begins with white space
            return None
        return self.feed.join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [self._blanks(t) if t else b"" for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._patterned([texts[i] for i in rest]) if rest else ()):
            out[i] = ids
        return out

    def _patterned(self, texts: list[str]) -> list[bytes]:
        apart = [bool(t) and odd(t) for t in texts]
        split = [STRETCH.findall(t) if t and not o else () for t, o in zip(texts, apart)]
        seen = set().union(*split) if split else set()
        if len(self.cache) + len(seen) > self.size:  # the older half goes, except what is asked for again
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        for stretch in seen.difference(cache):
            ids = old.get(stretch)
            cache[stretch] = self._stretch(stretch) if ids is None else ids
        get = cache.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        whole = [i for i, o in enumerate(apart) if o]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else ()):
            out[i] = ids
        return out


    def clear(self) -> bool:
        """Forget what was looked up; whether there was anything."""
        held = (self.cache, self.old, self.pieces, self.chunks, self.chunks.old, self.starts, self.starts.old)
        some = any(held)
        for x in held:
            x.clear()
        return some


def forget() -> None:
    """Give back the memory of this worker's lookups, for stages that encode nothing."""
    if any([e.clear() for e in _ENCODERS.values()]):
        import ctypes

        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps it for itself
            pass


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
