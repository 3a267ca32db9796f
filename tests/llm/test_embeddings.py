import math

import numpy as np

from lodestone.llm import embeddings
from lodestone.llm.embeddings import linked_vectors


def brute(rows, cosine=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    near = {i: set() for i, _ in rows}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y >= cosine * np.linalg.norm(x) * np.linalg.norm(y):
                near[a].add(b)
                near[b].add(a)
    seen = {}
    for i in sorted(near):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += near[x]
    return {i: (len(near[i]), seen[i], seen[i] == i) for i in near}


def corpus():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    rows = [v for v in base]
    rows += [v + 0.12 * rng.standard_normal(32) for v in base[:20] for _ in range(3)]
    rows += [base[0]] * 5 + [2 * base[1]]
    rows += [base[2] + 0.1 * rng.standard_normal(32) for _ in range(60)]
    rows = [v.astype(np.float32).tolist() for v in rows]
    rows += [None, [], [0.0] * 32, [float("nan")] * 32, [None, 1.0], [float("inf")] + [0.0] * 31, [1.0, 0.0], [1.0, 0.1]]
    return list(enumerate(rows))


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, size int")
    want = brute(rows)
    monkeypatch.setattr(embeddings, "MISS", 1e-6)
    for most in (1024, 16):
        monkeypatch.setattr(embeddings, "LIST", most)
        got = {r[0]: tuple(r[1:]) for r in linked_vectors(frame).collect()}
        assert got == want


def test_recall_of_the_calibration():
    rng = np.random.default_rng(4)
    tail, count = embeddings.calibrate(20_000, 0.9)
    a = embeddings.directions(64, count)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((300, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    p, q = x @ a, (0.9 * x + math.sqrt(0.19) * z) @ a
    hits = ((p >= tail) & (q >= tail) & (np.abs(p - q) <= embeddings.WINDOW)).sum(axis=1)
    assert (hits >= embeddings.COUNT).mean() > 0.97


def test_empty_table(spark):
    assert linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
