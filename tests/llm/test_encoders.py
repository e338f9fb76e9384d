"""Cached encoders against the libraries, on strings made to upset the cuts."""

import random
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np

from haplomill.llm import pieces, tokens

PARTS = [" ", "  ", "\n", "\t", "\r", "a", "Bc", "é", "ß", "'", "'s", "'ll", "1", "22", ".", ",", "!", "#", "_", "²", "½", "Ⅷ", "日", "😀", " ", "́", "<|endoftext|>"]


def strings(n, seed, parts):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 10))) for _ in range(n))]


def test_byte_level_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    library.encode_special_tokens = True
    texts = strings(6000, 1, PARTS)
    e = tokens.Encoder(tokens.vocabulary(), cache_size=500)  # small, so that generations change
    got = [x for i in range(0, len(texts), 400) for x in e.encode(texts[i : i + 400])]
    assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_piece_ids_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    path = tokens.vocabulary("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), pieces.Pieces(path, cache_size=500)
    texts = [*strings(6000, 2, [*PARTS, "▁", "the", "tion", "²."]), "x" * 3000]
    got = [x for i in range(0, len(texts), 400) for x in model.encode(texts[i : i + 400])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t) for t in texts]
    assert [model.decode(x) for x, t in zip(got, texts) if "▁" not in t] == [t for t in texts if "▁" not in t]


def as_unigram(model, rng):
    """A model file's bytes with its kind set to unigram and other scores, so that the library runs its own Viterbi."""
    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def message(fields):
        return b"".join(varint(k << 3 | (0 if isinstance(v, int) else 5 if k == 2 and len(v) == 4 else 2)) + (varint(v) if isinstance(v, int) else v if k == 2 and len(v) == 4 else varint(len(v)) + v) for k, v in fields)

    out = []
    for k, v in pieces._fields(model):
        if k == 1:
            piece = dict(pieces._fields(v))
            v = message([(1, piece[1]), (2, struct.pack("<f", -rng.randint(8, 160) / 8)), *([(3, piece[3])] if 3 in piece else [])])
        elif k == 2:
            at = v.index(b"\x18\x02")  # field 3 of the trainer's settings: 2
            assert dict(pieces._fields(v))[3] == 2
            v = v[:at] + b"\x18\x01" + v[at + 2 :]
        out.append(varint(k << 3 | 2) + varint(len(v)) + v)
    return b"".join(out)


def test_unigram_ids_equal_the_library(tmp_path):
    from sentencepiece import SentencePieceProcessor

    with open(tokens.vocabulary("piece_bpe_32k.model"), "rb") as f:
        data = as_unigram(f.read(), random.Random(7))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(data)
    library, model = SentencePieceProcessor(model_file=path), pieces.Pieces(path, cache_size=500)
    assert model.unigram
    texts = [*strings(3000, 3, [*PARTS, "▁", "the", "tion", "ing"]), "international interest in internal interns", "a" * 2000]
    got = [x for i in range(0, len(texts), 300) for x in model.encode(texts[i : i + 300])]
    assert [np.frombuffer(x, model.dtype).tolist() for x in got] == [library.encode(t) for t in texts]


def test_memory_is_linear_in_a_word():
    """One word of a million letters; the library's ids; the worker's growth stays far under 500 MB."""
    code = """
import resource, sys, random, zlib
from haplomill.llm import pieces, tokens
path = tokens.vocabulary("piece_bpe_32k.model")
model = pieces.Pieces(path)
model.encode(["warm up"])
rng = random.Random(1)
text = "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(1_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = model.encode([text])[0]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, model.decode(ids) == text)
import numpy as np, sentencepiece
print(np.frombuffer(ids, model.dtype)[:15_000].tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text[:60_000])[:15_000])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=300).stdout.split()
    assert int(out[0]) < 300 and out[1:] == ["True", "True"]
