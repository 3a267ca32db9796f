import random

import test_lines
import test_minhash
import test_repeats

import corpus_pipeline as P


def texts(df):
    assert set(P.COLUMNS) == set(df.columns)
    rows = df.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    return {r.doc_id: r.text for r in rows}


def corpus():
    rng = random.Random(12)
    vocabulary = [a + b for a in ("ba", "cé", "do", "fu", "gi", "ho") for b in ("ra", "se", "ti", "lo", "mu")]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, passage = line(9), line(25)
    rows, labels = [], []
    for i in range(90):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            lines.insert(0, shared)
        if rng.random() < 0.2:
            lines.append(line(4) + " " + passage + " " + line(4))
        toxic = int(i % 4 == 0)
        if toxic:
            lines[-1] += " nasty vile nasty"
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0, toxic))
    base = line(150).split(" ")
    for i in range(100, 108):
        copy = list(base)
        copy[rng.randrange(150)] = "changed" + str(i)
        rows.append((i, " ".join(copy)))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, None), (203, "")]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "suffix-array dedup", "packing"]
    step = dict(P.STAGES)

    clean = step["toxicity"](spark, docs, str(tmp_path))
    clean.write.parquet(f"{tmp_path}/clean.parquet")
    clean = spark.read.parquet(f"{tmp_path}/clean.parquet")
    left = texts(clean)
    toxic = {i for i, _, y in labels if y}
    assert len(toxic & left.keys()) <= 2 and len(set(dict(rows)) - toxic - left.keys()) <= 2

    lined = texts(step["line dedup"](spark, clean, str(tmp_path)))
    _, _, _, head = test_lines.brute(list(left.items()))
    want = {}
    for i, t in left.items():
        kept = [x for k, x in enumerate((t or "").split("\n")) if len(x) < test_lines.LEAST or head[x] == (i, k)]
        long = any(len(x) >= test_lines.LEAST for x in kept)
        if long or len(kept) == len((t or "").split("\n")):
            want[i] = None if t is None else "\n".join(kept)
    assert lined == want

    near = texts(step["minhash near-dedup"](spark, clean, str(tmp_path)))
    assert near == {i: left[i] for i, r in test_minhash.brute(list(left.items()), 80).items() if r[2]}

    cut = texts(step["suffix-array dedup"](spark, clean, str(tmp_path)))
    gone = {}
    seen = {}
    for i, t in sorted(left.items()):
        b = (t or "").encode()
        mask = [False] * len(b)
        for s in range(len(b) - 49):
            if seen.setdefault(b[s:s + 50], i) < i:
                mask[s:s + 50] = [True] * 50
        rest = bytes(x for x, g in zip(b, mask) if not g).decode("utf-8", "ignore")
        if rest or not t:
            gone[i] = None if t is None else rest
    assert cut == gone

    pieces = step["packing"](spark, clean, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == left.keys()


def test_new_short_lines_outlive_a_shared_header(spark):
    header = "a header line that many documents share"
    rows = [
        (1, header + "\nalpha"), (2, header + "\nbeta\ngamma"), (3, header + "\nbeta\n  \n"), (4, header), (5, "beta\nalpha"), (6, header + "\nalpha\ndelta"),
        (7, header + "\ndelta\ngamma")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert texts(P.line_dedup(spark, docs, "")) == {1: rows[0][1], 2: "beta\ngamma", 5: "beta\nalpha", 6: "alpha\ndelta"}


def test_run_over_a_folder(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids <= set(dict(rows)) and 200 not in ids and len(ids & set(range(100, 108))) >= 1
    assert sum(r.length for r in got if r.start == 0) > 0


def test_brute_force_modules_are_shared():
    assert test_repeats.brute([(1, "a" * 60), (2, "a" * 60)])[2][1] == 60
