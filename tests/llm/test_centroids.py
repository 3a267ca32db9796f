import hashlib
import random

import pytest

from lodestone.llm.centroids import Bisectors, clusters, integers

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k=8, rounds=10, size=64):
    kept = [(i, [int(v * 1024 // 1) for v in x]) for i, x in rows if x and len(x) == size and all(v is not None and abs(v) < float("inf") for v in x)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cents = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, *nearest(x)) for i, x in kept]
    per = {}
    for _, d, j in out:
        per[j] = per.get(j, 0) + d
    return sorted(
        ((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, x, "mine") for i, x in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in clusters(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_matches_plain_rounds(spark):
    """Ties, repeated rows, repeated and null ids, unusable vectors, negative components."""
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(i + 100, rows[i][1]) for i in range(20)] + [(7, [0.0] * 4), (None, [0.5] * 4), (None, rows[3][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4)]
    rows += [(906 + i, [float(v) for v in (i % 3, 1, 0, -1)]) for i in range(12)]
    assert run(spark, rows, size=4, k=5) == plain(rows, size=4, k=5)


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.3, -0.2])]
    assert run(spark, rows, size=2) == plain(rows, size=2)
    assert run(spark, [], size=2) == []
    assert run(spark, [(None, [0.1, 0.2])], size=2) == []


def test_wide_components_stay_exact(spark):
    rows = [(i, [1e12 * i + 0.5, -3e14 / (i + 1)]) for i in range(12)] + [(50, [0.25, 0.5])]
    want = plain(rows, size=2, k=3)
    got = run(spark, rows, size=2, k=3)
    clip = [(i, j, *(d if d < 1 << 63 else None for d in ds), h) for i, j, *ds, h in want]
    assert got == sorted(clip, key=str)


@pytest.mark.parametrize("value,whole", [(0.5, 512), (-0.0001, -1), (1e305, int(1e305) * 1024), (-2.0 ** 60 - 0.5, -(2 ** 70))])
def test_integers(value, whole):
    import numpy as np
    assert integers(np.array([[value]]))[0, 0] == whole


def test_zero_favours_the_smaller_number():
    import numpy as np
    winner, distance = Bisectors([[0, 0], [2, 0], [2, 0]]).nearest(np.array([[1, 5], [2, 0], [0, 0]]))
    assert winner.tolist() == [0, 1, 0] and distance.tolist() == [26, 0, 0]
