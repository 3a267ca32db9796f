import hashlib
import random

from pyspark.sql import functions as F

from lodestone.llm import repeats
from lodestone.llm.repeats import without_repeats


def brute(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if seen.setdefault(b[s:s + 50], i) < i:
                gone[s:s + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).digest())
    return out


def corpus():
    rng = random.Random(9)
    word = ["ba", "cé", "dok", "é", "full", "gg", "hi", "ii", "jo", "k"]

    def prose(n):
        return " ".join(rng.choice(word) + rng.choice(word) for _ in range(n))
    passages = [prose(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, 20)
            parts += [p[lo:lo + rng.randint(30, 120)], prose(rng.randint(0, 15))]
        rows.append("".join(parts))
    near = list(prose(120))
    for _ in range(8):
        near[rng.randrange(len(near))] = "#"
        rows.append("".join(near))
    rows += [rows[3], rows[3], "a" * 400, "a" * 49, "a" * 50, "ab" * 90, "b" + "ab" * 60, None, "", "short", "x" * 3000 + rows[5]]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3, F.col("doc_id") % 7)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in without_repeats(frame, with_text=False).collect()}
    assert got == brute(rows)


def test_part_of_a_section_that_its_document_repeats(spark):
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k in range(20):
        passage, section = noise(50 + 2 * k), (noise(60), noise(60))
        again = section[0] + passage + section[1]
        rows += [(3 * k, noise(60) + passage + noise(60)), (3 * k + 1, again + " | " + again), (3 * k + 2, noise(9) + again + again + again)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in without_repeats(frame, with_text=False).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
