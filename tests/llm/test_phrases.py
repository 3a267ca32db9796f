import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import phrases
from lodestone.llm.phrases import Index, _packed_keys, _sequence, _unpacked, bwt, collocations, squeezed, tokens, unsqueezed

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, percent=50, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = set()
    for p, a in cands.items():
        if len(p) == 4:
            held |= {(p[0], *q) for q in (p[1:3], p[2:4]) if 100 * a >= percent * cands[(p[0], *q)]}
    out = []
    for lang in total:
        rows = []
        for p, a in cands.items():
            if p[0] == lang and p not in held:
                cuts = [(10**6 * a * a // (f[p[:k + 1]] * f[(lang, *p[k + 1:])]), k, f[p[:k + 1]], f[(lang, *p[k + 1:])]) for k in range(1, len(p) - 1)]
                score, _, l, r = min(cuts)
                rows.append((-score, -a, " ".join(p[1:]).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, n, size=9):
    draw = random.Random(seed)
    vocab = ["ab", "Ab", "c", "zé", "z", "日", "x y", "long" * 40, "\u000e", "q"][:size]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "?!", "\x0b", " - "]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(vocab) + draw.choice(ends[:3] * 4 + ends) for _ in range(draw.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), ("fr", ""), ("de", " .. "), ("en", "ab " * 3000), ("en", rows[0][1]), ("en", rows[0][1])]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, l, t, "x") for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, word string").repartition(5)
    return sorted(tuple(r) for r in collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard,least,top", [(1_000_000, 10, 2000), (150, 3, 7)])
def test_matches_plain_counts(spark, monkeypatch, shard, least, top):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BUCKET", 500)
    rows = corpus(3, 120)
    assert run(spark, rows, least=least, top=top) == plain(rows, least, 50, top)


def test_empty(spark):
    assert run(spark, []) == [] == run(spark, [("en", None), ("en", "a b c")])


def test_intervals_find_every_phrase():
    """Bidirectional extension on one shard against a scan, with some words unwanted."""
    draw = np.random.default_rng(1)
    text = np.concatenate(([0], draw.integers(0, 6, 400), [0]))
    wanted = np.array([False, True, True, False, True, True])
    found = {}
    for columns, count in Index(bwt(text, 3), bwt(text[::-1], 3), wanted).grams():
        found |= {tuple(map(int, g)): int(c) for *g, c in zip(*columns, count)}
    want = Counter()
    for k in (2, 3):
        want.update(g for g in (tuple(map(int, text[i:i + k])) for i in range(len(text) - k + 1)) if all(wanted[w] for w in g))
    assert found == dict(want)


def test_pieces_and_keys():
    words, piece = tokens([b"A b.C", b"", b"d"])
    distinct, text = _sequence([words], [piece])
    assert distinct.to_pylist() == [b"a", b"b", b"c", b"d"] and text.tolist() == [0, 1, 2, 0, 3, 0, 4, 0]
    columns = tuple(np.array(c, np.int64) for c in ([5, 2**40], [7, 1], [0, 2**41 - 1]))
    assert [c.tolist() for c in _unpacked(_packed_keys(columns, 41), 3, 41)] == [c.tolist() for c in columns]
    a, b = np.arange(5, dtype=np.int64), np.array([9, 9, 1, 2, 3], np.uint32)
    assert [x.tolist() for x in unsqueezed(squeezed(a, b), "<i8", "<u4")] == [a.tolist(), b.tolist()]
    assert [x.tolist() for x in unsqueezed(squeezed(a[:0]), "<i8")] == [[]]
