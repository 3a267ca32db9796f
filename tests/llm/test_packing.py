import random
import zlib

import numpy as np
import pytest

from lodestone.llm.packing import LENGTH, cutting_stock, encoder, packed, price


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path())
    rng = random.Random(1)
    texts = ["", " ", "Hello  world\n\n x", "naïve 日本 😀‍", "a" * 5000, "   \t\n" * 300, "<|endoftext|> 1234567 it's", "a <|endoftext|> b"]
    texts += ["".join(rng.choice("abc é\n .,;'12😀") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    encode = encoder(path())
    assert [encode(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_price_finds_the_best_pattern():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes, values, room = rng.integers(1, 9, 3), rng.random(3), 14
        best = max(values @ (a, b, c) for a in range(15) for b in range(15) for c in range(15) if sizes @ (a, b, c) <= room)
        value, pattern = price(values, sizes, room)
        assert value == pytest.approx(best) and sizes @ pattern <= room and values @ pattern == pytest.approx(value)


def test_cutting_stock_holds_every_item_in_few_sequences():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40):
        sizes = np.sort(rng.choice(np.arange(1, 257), n, replace=False))
        counts = rng.integers(1, 500, n)
        plan = cutting_stock(sizes, counts.astype(float), 256)
        assert (sum(c * p for c, p in plan) == counts).all() and all(sizes @ p <= 256 and c > 0 for c, p in plan)
        assert sum(c for c, _ in plan) <= sizes @ counts / 256 * 1.02 + n + 1 or sizes.max() > 128
    assert cutting_stock(np.zeros(0, np.int64), np.zeros(0), 256) == []


def test_pieces_cover_documents_and_sequences(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "delta\n"]) for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "tie"), (902, "tie"), (None, "no id"), (903, "x" * 40_000), *[(1000 + i, "same words here") for i in range(300)]]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    got = packed(frame).collect()
    encode, want, have = encoder(path()), {}, {}
    for i, t in rows:
        ids = np.array([*encode(t or ""), 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        have.setdefault(r.doc_id, []).append(r)
    assert have.keys() == want.keys()
    for i, docs in want.items():
        pieces = sorted(have[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(n for n, _ in docs)
        if len(docs) == 1:
            ids = np.array([*encode(dict(rows)[i] or ""), 0], "<u4")
            at = 0
            for r in pieces:
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
                at += r.length
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH
    assert len(sequences) <= sum(r.length for r in got) / LENGTH * 1.03 + 8
    assert packed(frame.where("doc_id < 0")).count() == 0
