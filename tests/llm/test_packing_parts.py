"""Pieces of a text by the tokenizer's own library."""

import random
import zlib

import numpy as np
from geoloom.llm import packing


def whole_pieces(text):
    """(piece, length, crc32 of the ids) of a text."""
    from tokenizers import Tokenizer

    x = [*Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 0]
    n = len(x)
    first = n if n <= 2048 else n % 2048 or 2048
    cuts = [0, *range(first, n, 2048), n] if n > first else [0, n]
    return [(k, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def test_whole_pieces():
    pieces = whole_pieces("a " * 5000)
    assert [k for k, _, _ in pieces] == list(range(len(pieces))) and all(n == 2048 for _, n, _ in pieces[1:]) and 0 < pieces[0][1] <= 2048
    assert whole_pieces("")[0][:2] == (0, 1)


def _same(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.Encoder(packing.default_tokenizer()).encode([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_on_code_points():
    points = [c for c in (*range(0x3000), *range(0x3000, 0x20000, 11)) if not 0xD800 <= c < 0xE000]
    _same([f"ab{chr(c)}cd {chr(c)}1{chr(c)} {chr(c)}\n" for c in points])


def test_encoder_on_white_space_of_all_kinds():
    rng = random.Random(3)
    spaces = " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u180e\u2003\u200b\u2028\u2029\u202f\u205f\u3000"
    others = ["a", "B", "é", "e\u0301", "9", "٣", "'s", ".", ",", "...", "’", "<|endoftext|>", "漢字", "😀", "x1", "#", "ñ"]
    texts = ["one two\n\u00a0\nthree four", "\u00a0", "", "\u00a0 x", "\n\n", "Hello world."]
    texts += ["".join(rng.choice(spaces) if rng.random() < 0.4 else rng.choice(others) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0x3000), 10, 32, 32])) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    _same(texts)
    for at in range(0, 300, 3):
        _same(texts[at : at + 3])
