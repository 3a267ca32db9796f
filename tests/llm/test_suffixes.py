import random

from lodestone.llm.suffixes import suffix_ranks


def test_ranks_match_sorted_suffixes(spark):
    rng = random.Random(5)
    strings = [[rng.randrange(2) for _ in range(rng.randint(1, 40))] for _ in range(6)] + [[7] * 30, [7] * 30, [1, 2, 3] * 8]
    rows, at = [], 4
    for s in strings:
        rows += [(at + i, v) for i, v in enumerate(s)]
        at += len(s) + rng.randint(1, 3)
    symbols = dict(rows)

    def suffix(p):
        out = []
        while p in symbols:
            out.append((1, symbols[p]))
            p += 1
        return [*out, (0, p)]

    got = {r.pos: r.rank for r in suffix_ranks(spark.createDataFrame(rows, "pos long, s0 long")).collect()}
    assert sorted(got.values()) == list(range(len(rows)))
    order = sorted(got, key=got.get)
    # The first symbol after an end is ordered by the position of the end.
    assert order == sorted(symbols, key=suffix)


def test_depth_groups_equal_prefixes(spark):
    rng = random.Random(6)
    symbols = {i: rng.randrange(3) for i in range(200) if i % 41}
    got = {r.pos: r.rank for r in suffix_ranks(spark.createDataFrame(list(symbols.items()), "pos long, s0 long"), depth=2).collect()}
    order = [(symbols[p], symbols[p + 1]) for p in sorted(got, key=lambda p: (got[p], p)) if p + 1 in symbols]
    assert len(got) == len(symbols)
    assert order == sorted(order)


def test_empty(spark):
    assert suffix_ranks(spark.createDataFrame([], "pos long, s0 long")).count() == 0
