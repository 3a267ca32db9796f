import random
import re

from lodestone.llm.minhash import near_duplicates


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choices(vocabulary, k=rng.randint(1, 160)) for _ in range(60)]
    for words in base:
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append("\n".join(copy))
    hub = rng.choices(vocabulary, k=200)
    for _ in range(120):  # a crowded region
        copy = list(hub)
        copy[rng.randrange(200)] = rng.choice(vocabulary)
        copy[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [None, "", " \t\n", "one", "ONE", "Ünï one", "one two three four", "one two three four", "x " * 30_000, "x " * 20_000]
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, n string")
    for percent in (85, 80):
        got = {r[0]: tuple(r[1:]) for r in near_duplicates(frame, percent=percent).collect()}
        assert got == brute(rows, percent)


def test_empty_table(spark):
    got = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0


def test_neighbours_across_tasks(spark):
    """Pairs within a region at every distance, whatever the cut into tasks, equal paths and one region in all of them."""
    from lodestone.llm.minhash import _neighbours
    rng = random.Random(4)
    for size, steps, parts in ((300, 3, 7), (40, 8, 12), (5, 2, 9), (0, 2, 3)):
        rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(9), i, rng.randrange(6), rng.randint(80, 110)) for i in range(size)]
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted(tuple(r) for r in _neighbours(spark.createDataFrame(rows, "region long, path long, rep long, comp long, n long"), steps, 85).collect())
        ordered, want = sorted(rows), set()
        for i, x in enumerate(ordered):
            want |= {(min(x[2], y[2]), max(x[2], y[2])) for y in ordered[i + 1:i + steps + 1] if x[0] == y[0] and x[3] != y[3] and 100 * min(x[4], y[4]) >= 85 * max(x[4], y[4])}
        assert got == sorted(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_crowded_regions_keep_next_neighbours_and_small_ones_all(spark):
    from lodestone.llm.minhash import _neighbours
    rng = random.Random(5)
    rows = [(1, rng.randrange(9), i, i, 100) for i in range(60)] + [(2 + i // 5, rng.randrange(9), 100 + i, i, 100) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = {tuple(r) for r in _neighbours(spark.createDataFrame(rows, "region long, path long, rep long, comp long, n long"), 8, 85, 9).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = sorted(rows)
    must, may = set(), set()
    for i, x in enumerate(ordered):
        for d, y in enumerate(ordered[i + 1:i + 9], 1):
            if x[0] == y[0]:
                pair = (min(x[2], y[2]), max(x[2], y[2]))
                may.add(pair)
                if d == 1 or x[0] > 1:
                    must.add(pair)
    assert must <= got <= may and len(got) < len(may)
