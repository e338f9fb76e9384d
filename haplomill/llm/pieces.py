"""Sentence-piece encoding and decoding by a forward pass shared between common prefixes.

Text becomes marked words (a blank is written as a mark before its word). The distinct marked words of a batch are
sorted, which is the depth-first order of their trie; the forward state of each prefix stays on a stack, so a word
only computes what lies beyond the prefix it shares with the word before. A prefix keeps its last piece alone, which
points back to the prefix before it, so memory is linear in the longest word.

For a unigram vocabulary the state of a prefix is its best score (Viterbi): the largest sum of the scores of pieces that
make it up, the longer last piece among equals. A merge vocabulary has no additive score: a path is right if
neighbouring pieces stay apart when the merges run over the two of them alone, and exactly one last piece of each prefix
satisfies that, so the same pass keeps that piece. An automaton over the pieces names those that may end at each prefix.
Characters without a piece fall back to byte pieces, and never join a neighbour.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .tokens import vocabulary

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LETTER = re.compile(r"[^\W\d_]")
#: Characters that stand alone in the vocabularies known here; checked against the pieces before use.
SINGLE = "\n0123456789"
#: Longer words seldom come again and are not kept.
LONGEST = 100
#: What a character without a piece scores below the worst piece (fixed by the unigram model).
UNKNOWN = 10.0
ENCODED = "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def is_unigram(model: bytes) -> bool:
    """Whether a model file says so: field 3 of its field 2 is 1 for a unigram vocabulary (the default) and 2 for merges."""
    kind = 1
    for number, spec in _fields(model):
        if number == 2:
            kind = next((v for k, v in _fields(spec) if k == 3), kind)
    if kind not in (1, 2):
        raise ValueError("only unigram and merge vocabularies are known")
    return kind == 1


class Pieces:
    """The vocabulary of a model file, and the forward pass over it."""

    def __init__(self, path: str, cache_size: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.unigram = is_unigram(model.serialized_model_proto())
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if n <= 1 << 16 else "I"
        self.byte_ids, self.shown = [-1] * 256, [b""] * n
        scores = []
        for i in range(n):
            piece = model.id_to_piece(i)
            scores.append(model.get_score(i))
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.shown[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.shown[i] = piece.replace(MARK, " ").encode()
        if min(self.byte_ids) < 0:
            raise ValueError("a character without a piece needs byte pieces")
        self.scores = scores
        self.unknown = min((scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN
        self.own: dict[str, bytes] = {}
        self.inside = any(MARK in p.lstrip(MARK) for p in self.ids)  # then no blank separates words
        self.word = self._word()
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.nodes: dict[str, tuple] = {}
        self.root = self.nodes[""] = ((), {}, "")
        self.n_pairs = 0
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = cache_size

    def _word(self) -> re.Pattern:
        """What a text is cut into: no piece spans two words.

        Merges only make pieces, so two characters that no piece holds side by side always stay apart. Where that
        holds for letters against all else and for the single characters, they end words as well as blanks do.
        """
        beside = {(a, b) for p in self.ids for a, b in zip(p, p[1:]) if a != MARK}
        odd = {c for a, b in beside if bool(LETTER.match(a)) != bool(LETTER.match(b)) for c in (a, b) if LETTER.match(c)}
        letter = lambda c: bool(LETTER.match(c)) and c not in odd
        if len(odd) > 20 or any(letter(a) != letter(b) or a in SINGLE or b in SINGLE for a, b in beside):
            return WORD
        out = re.escape("".join(sorted(odd)))
        return re.compile(f"{MARK}*[^\\W\\d_{out}]+|{MARK}*[{SINGLE}]|{MARK}*(?:(?![{SINGLE}{MARK}])[\\W\\d_{out}])+|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """The merges as defined: the best-scored adjacent pair first, leftmost among equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple] = []

        def offer(i: int) -> None:
            if after[i] < len(parts):
                found = ids.get(parts[i] + parts[after[i]])
                if found is not None:
                    heapq.heappush(queue, (-scores[found], i, parts[i], parts[after[i]]))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _grow(self, node: tuple, char: str) -> tuple:
        """The node after a character: the pieces that may end there, longest first, and the nodes that follow.

        A node is named by the longest suffix of what was read that begins some piece, so there are no more nodes
        than beginnings of pieces (and characters without one).
        """
        name = node[2] + char
        while len(name) > 1 and name not in self.prefixes:
            name = name[1:]
        found = self.nodes.get(name)
        if found is None:
            ends = []
            for at in range(len(name)):
                piece = name[at:]
                known = self.ids.get(piece)
                if known is not None and (self.unigram or self.merged(piece) == [piece]):
                    ends.append((piece, len(piece), {}, self.scores[known]))
                elif len(piece) == 1:
                    ends.append((piece, 1, {}, self.unknown))
            found = (tuple(ends), {}, name)
            if len(self.nodes) < 400_000:
                self.nodes[name] = found
        if len(self.nodes) < 400_000:
            node[1][char] = found
        return found

    def _apart(self, left: str, right: str, known: dict[str, bool]) -> bool:
        self.n_pairs += 1
        if self.n_pairs > 1_500_000:
            self.n_pairs = 0
            for ends, _, _ in self.nodes.values():
                for e in ends:
                    e[2].clear()
        found = known[left] = self.merged(left + right) == [left, right]
        return found

    def _own(self, piece: str) -> bytes:
        found = self.own.get(piece)
        if found is None:
            known = self.ids.get(piece)
            found = array(self.code, [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]).tobytes()
            if len(self.own) < 400_000:
                self.own[piece] = found
        return found

    def _back(self, word: str, last: list) -> bytes:
        """The ids of a word, from its last piece back to its first."""
        end, out = len(word), []
        while end:
            out.append(self._own(last[end]))
            end -= len(last[end])
        out.reverse()
        return b"".join(out)

    def forward(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as little-endian integers) of sorted distinct words."""
        before, unigram = "", self.unigram
        nodes, last, best = [self.root], [""], [0.0]  # of each prefix: node, last piece, forward score
        for word in words:
            n, shared = min(len(word), len(before)), 0
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del nodes[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            node, end = nodes[-1], shared
            for char in word[shared:]:
                node = node[1].get(char) or self._grow(node, char)
                nodes.append(node)
                end += 1
                if unigram:
                    top, kept = None, None
                    for piece, size, _, score in node[0]:
                        total = best[end - size] + score
                        if top is None or total > top:
                            top, kept = total, piece
                    last.append(kept)
                    best.append(top)
                    continue
                for piece, size, known, _ in node[0]:
                    left = last[end - size]
                    if left is None:
                        continue
                    if left:
                        apart = known.get(left)
                        if apart is None:
                            apart = self._apart(left, piece, known)
                        if not apart:
                            continue
                    last.append(piece)
                    break
                else:
                    last.append(None)
            yield word, self._back(word, last) if last[-1] is not None else b"".join(map(self._own, self.merged(word)))
            before = word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        split = [[m] if self.inside and m else self.word.findall(m) for m in marked]
        seen = set().union(*split) if split else set()
        if len(self.cache) + len(seen) > self.size:  # the older half goes, except what is asked for again
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        fresh = seen.difference(cache)
        for w in fresh.intersection(old):
            cache[w] = old[w]
        long = {}
        for w, ids in self.forward(sorted(fresh.difference(old))):
            (cache if len(w) <= LONGEST else long)[w] = ids
        return [b"".join([cache.get(w) or long[w] for w in s]) if long else b"".join(map(cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        shown = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        text = shown.decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """ENCODED: the ids of each whole text and a check of what they decode to, one row per row of docs.

    No normalisation but the blank marks and the mark before the text, so decoding gives the text back (a mark that
    stands in the text itself comes back as a blank; round_trip is then false). Null or empty text has no ids; a text or
    a word of any length is encoded whole, in memory linear in it; a null doc_id stays null; repeated rows stay; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = model.encode(texts)
                back = [model.decode(x) for x in ids]
                wide = [np.frombuffer(x, model.dtype).astype("<i4") for x in ids]
                ends = np.concatenate(([0], np.cumsum([len(w) for w in wide])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(wide)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in wide], pa.int64()), lists, pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([x == y for x, y in zip(back, texts)])],
                    [x.split()[0] for x in ENCODED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
