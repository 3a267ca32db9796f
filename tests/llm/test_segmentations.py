import math
import random

import numpy as np

from lodestone.llm import segmentations as S

PATH = S.default_path()


def every(words, text):
    """All segmentations of a text with their log probabilities, by plain recursion over the whole marked text."""
    weight = {}
    for size, (_, ids, weights) in words.by_length.items():
        for i, w in zip(ids.tolist(), weights.tolist()):
            weight[words.pieces[i]] = (w, (i,))
    marked = S.SPACE + text.replace(" ", S.SPACE)

    def step(at):
        if at == len(marked):
            return [((), 0.0)]
        out = []
        options = {marked[at:at + n]: weight.get(marked[at:at + n]) for n in range(1, 17) if at + n <= len(marked)}
        if options[marked[at]] is None:
            raw = marked[at].encode()
            options[marked[at]] = (words.byte_weight * len(raw), tuple(int(words.byte_ids[b]) for b in raw))
        for piece, found in options.items():
            if found:
                out += [(found[1] + rest, found[0] + w) for rest, w in step(at + len(piece))]
        return out
    paths = step(0)
    total = np.logaddexp.reduce([w for _, w in paths])
    return {p: w - total for p, w in paths}


def draws(text, keys, k):
    words = S.vocabulary(PATH)
    lattice = S.Lattice(words, [text] * len(keys))
    paths, logs, values, kappa = S.sample(lattice, S.key_seeds(keys), k)
    ids = [S.path_ids(lattice, p) for p in paths]
    return [[(tuple(ids[s][i].tolist()), logs[s, i], values[s, i]) for s in range(k) if not np.isneginf(values[s, i])] for i in range(len(keys))], kappa


def test_samples_are_different_segmentations_with_their_probabilities():
    words = S.vocabulary(PATH)
    for text in ("a", "the cat", "  two\n é", "日本😀x", "\n\n"):
        want = every(words, text)
        got, kappa = draws(text, list(range(40)), 6)
        for row, left in zip(got, kappa):
            assert len({p for p, _, _ in row}) == len(row) == min(6, len(want))
            assert np.isneginf(left) == (len(want) <= 6)
            assert all(math.isclose(log, want[p], abs_tol=1e-9) for p, log, _ in row)
            perturbed = [v for _, _, v in row]
            assert perturbed == sorted(perturbed, reverse=True) and perturbed[-1] > left
            assert all(S.decode(words, np.array(p)) == text for p, _, _ in row)


def test_first_draw_and_inclusion_follow_the_distribution():
    words = S.vocabulary(PATH)
    want = every(words, "then it")
    n, k = 6000, 4
    got, kappa = draws("then it", list(range(n)), k)
    first = {}
    for row in got:
        first[row[0][0]] = first.get(row[0][0], 0) + 1
    for p, log in want.items():
        e = math.exp(log)
        assert abs(first.get(p, 0) / n - e) < 5 * math.sqrt(e / n) + 1e-9
    # Weighted by their inclusion scores, samples estimate any sum: here the probability of all segmentations, and a length.
    total = [sum(math.exp(log) / -math.expm1(-math.exp(log - c)) for _, log, _ in row) for row, c in zip(got, kappa)]
    assert abs(np.mean(total) - 1) < 0.02
    size = [sum(len(p) * math.exp(log) / -math.expm1(-math.exp(log - c)) for p, log, _ in row) for row, c in zip(got, kappa)]
    assert abs(np.mean(size) - sum(len(p) * math.exp(log) for p, log in want.items())) < 0.1


def test_tables(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 12))) for _ in range(3000))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "x" * 3000), (6, "one two"), (6, "one two"), (None, "a b")]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, place string")
    samples = S.sampled(frame)
    got = S.decoded(samples).collect()
    other = {(r.doc_id, r.place): r.ids for r in S.sampled(frame.repartition(5)).collect()}
    texts = dict(rows)
    for r in got:
        assert r.decoded == texts[r.doc_id] and other[r.doc_id, r.place] == r.ids and r.n_pieces == len(r.ids)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert len(set(by_key[1])) == 4 and set(by_key[1]) != set(by_key[2])
    assert 3 not in by_key and 4 not in by_key and len(by_key[6]) == 8 and len(set(by_key[6])) == 4
    assert S.sampled(frame.where("doc_id = 3")).count() == 0
