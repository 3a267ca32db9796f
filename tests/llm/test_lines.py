import random

import numpy as np

from lodestone.llm.lines import LEAST, line_classes, line_members, within, without_near_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        what = rng.randrange(3)
        if what == 0:
            s.insert(k, rng.choice("abé😀 "))
        elif s and k < len(s):
            if what == 1:
                del s[k]
            else:
                s[k] = rng.choice("abé😀 ")
    return "".join(s)


def test_banded_distance():
    rng = random.Random(1)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 30)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    points = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in zip(*pairs)]
    for edits in (1, 2, 3):
        got = within(points[0], points[1], edits)
        assert got.tolist() == [distance(a, b) <= edits for a, b in pairs]


def corpus():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh é😀") for _ in range(rng.randint(1, 70))) for _ in range(80)]
    base += ["x" * n for n in range(12, 24)]
    rows = []
    for i in range(70):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])).replace("\n", "") for _ in range(rng.randint(1, 8))]
        rows.append((2 * i, "\n".join(lines)))
    return rows + [(141, None), (143, ""), (145, "\n\n"), (147, base[0] + "\r"), (149, "y" * 50_000), (151, "y" * 49_999)]


def brute(rows, edits=2):
    first, count = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            first.setdefault(line, (i, k))
            count[line] = count.get(line, 0) + 1
    long = [x for x in first if len(x) >= LEAST]
    near = {x: [] for x in first}
    for k, a in enumerate(long):
        for b in long[k + 1:]:
            if abs(len(a) - len(b)) <= edits and (len(a) > 1000 or distance(a, b) <= edits):
                near[a].append(b)
                near[b].append(a)
    head = {}
    for x in sorted(first, key=first.get):
        todo = [x] if x not in head else []
        while todo:
            y = todo.pop()
            if y not in head:
                head[y] = first[x]
                todo += near[y]
    return first, count, near, head


def test_classes_and_removal_match_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int").repartition(3)
    first, count, near, head = brute(rows)
    want = sorted((*first[x], len(x), count[x], len(near[x]), *head[x]) for x in first)
    assert sorted(tuple(r) for r in line_classes(frame).collect()) == want

    got = {r.doc_id: (r.text, r.n_removed) for r in without_near_lines(frame).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if len(x) < LEAST or head[x] == (i, k)]
        assert got[i] == ("\n".join(kept), len(lines) - len(kept))


def test_op2_has_every_line_of_every_document(spark, tmp_path):
    from lodestone.llm.queries import QUERIES

    rows = corpus()[:12] + [(141, None), (200, corpus()[1][1]), (201, corpus()[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, count, near, head = brute(rows)
    want = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            want.append((i, k, len(x), count[x], len(near[x]), *head[x], len(x) < LEAST or head[x] == (i, k)))
    found = QUERIES["op2_line_dedup"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "line", "size", "occurrences", "n_links", "class_id", "class_line", "kept"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_no_members_of_an_empty_table(spark):
    assert line_members(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert line_classes(frame).count() == 0 and without_near_lines(frame).count() == 0
