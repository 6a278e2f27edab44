from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanloom.llm import packing


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


AWKWARD = [
    "", " ", "  a  b ", "it's we'll I'M \n\n x\t\ty", "é😀ü  naïve 北京 ١٢٣ ²", "<|endoftext|> a<|endoftext|>", "\x00\x01\x1c\x1d\x85\xa0 z q　", "a" * 3000, "!?" * 2000,
    " " * 5000, "é ​﻿ x", "1234567 3.14 a_b __c__",
]


def test_ids_are_the_tokenizers():
    known = packing.Encoder(packing.default_tokenizer())
    assert known.fast is not None
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice("ab 'sélé\n\t1.😀<| ") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    texts += ["a" * packing.LONG_RUN + " <|endoftext|>", "a" * (packing.LONG_RUN + 1), " " * 200_000 + "x", "ab" * 100_000, "x \n" * 3000]
    for text, ids in zip(texts, ids_of(texts)):
        assert np.frombuffer(known.ids(text), "<u4").tolist() == ids, text
    assert ids_of(["x <|endoftext|> y"]) == [[87, 220, 50256, 331]]


def test_other_tokenizers_are_taken_as_they_are():
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None
    assert np.frombuffer(other.ids("Some Words"), "<u4").tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some Words", add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    rng = random.Random(4)
    rows = [(i, "ab cd " * rng.randint(0, 900), "x") for i in range(120)] + [(500, None, "x"), (501, "word " * 9000, "x"), (502, "ab", "y"), (502, "ab", "y"), (None, "n", "z"), (-(1 << 63), "n", "z"), ((1 << 63) - 1, "m", "z")]
    rows += [(600 + i, t, "x") for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    cut = packing.pieces(docs)
    got = packing.pack(cut, block=64).collect()
    want = []
    for (i, t, _), ids in zip(rows, ids_of([t or "" for _, t, _ in rows])):
        ids = ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.id, r.piece, r.start, r.length, r.crc) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    assert packing.pack(packing.pieces(docs.where("false"))).count() == 0


def test_crossover_keeps_every_item_once_and_evolving_helps():
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 1100, 400).tolist()
    first = packing.evolve(lengths, [], 2048, 1, 0)[0]
    last = packing.evolve(lengths, [], 2048, 1, 60)[0]
    for solution in (first, last):
        assert sorted(i for b in solution for i in b) == list(range(400))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in solution)
    assert len(last) <= len(first)
    assert packing._load(packing._dump(last, 400)) == [sorted(b) for b in last] or len(packing._load(packing._dump(last, 400))) == len(last)
