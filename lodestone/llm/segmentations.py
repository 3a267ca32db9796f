"""SentencePiece encoding and decoding with segmentations sampled without replacement.

All segmentations of a text into pieces of a vocabulary form a lattice.  A piece weighs a power of its rank, since models of
merges hold ranks and no probabilities; characters outside the vocabulary fall back to their bytes.  Backward sums over the
lattice turn weights into the probability of each next piece.

Gumbel top-k: every segmentation has its log probability plus Gumbel noise, and the k largest are a sample without replacement.
The search is best first: an open node stands for all segmentations that leave a known path at one place, and carries the exact
maximum of their perturbed values, drawn from their summed probability and bounded by the node it was split from.  The best
open node is the next sample; it is followed down to one segmentation, which opens nodes along its way.  The largest value
that is left, kappa, gives each sample its inclusion score ``1 - exp(-exp(log p - kappa))``.

Pieces don't cross words, so the lattice is built once per different word of a block of text.  All randomness comes from
hashes of the row key, the sample and the place in the text: equal rows give equal samples wherever they are computed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import U64, blocks, char_prefix, char_span, mix, raw_span, utf8

SAMPLES = 4
POWER = 1.0
BLOCK = 1 << 19
SPACE = "▁"
_FILTER = 1 << 20


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes, ids and log weights; filters of all hashes and of beginnings; ids of bytes."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    seen: np.ndarray
    begins: dict[int, np.ndarray]  # by length: a filter of the beginnings of pieces
    byte_ids: np.ndarray
    byte_weight: float
    breaks: str  # characters that no piece holds next to others, where words may be cut
    pieces: list[str]


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes * U64(0x9FB21C651E98DF25)) >> U64(44)


_LOADED: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, power: float = POWER) -> Vocabulary:
    if (path, power) in _LOADED:
        return _LOADED[path, power]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    byte_ids, groups = np.zeros(256, np.int32), {}
    for i, p in enumerate(pieces):
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            groups.setdefault(len(p), []).append(i)
    by_length, seen = {}, np.zeros(_FILTER, bool)
    for size, ids in groups.items():
        data = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32)
        at = np.arange(len(ids)) * size
        hashes = raw_span(char_prefix(data), at, at + size)
        order = np.argsort(hashes)
        ids = np.array(ids, np.int32)[order]
        by_length[size] = (hashes[order], ids, -power * np.log(2.0 + ids))
        seen[_place(hashes)] = True
    begins = {}
    for size in range(1, max(by_length) + 1):
        starts = sorted({p[:size] for p in (pieces[i] for n, (_, ids, _) in by_length.items() if n >= size for i in ids.tolist())})
        data, at = np.frombuffer("".join(starts).encode("utf-32-le"), np.uint32), np.arange(len(starts)) * size
        begins[size] = np.zeros(_FILTER, bool)
        begins[size][_place(raw_span(char_prefix(data), at, at + size))] = True
    inside = {c for p in pieces for c in p[1:]} | {c for p in pieces if len(p) > 1 for c in p[0]}
    crossing = any(SPACE in p.lstrip(SPACE) for p in pieces)
    breaks = ("" if crossing else SPACE) + ("" if "\n" in inside else "\n")
    _LOADED[path, power] = Vocabulary(by_length, seen, begins, byte_ids, -power * float(np.log(2.0 + len(pieces))), breaks, pieces)
    return _LOADED[path, power]


class Lattice:
    """The words of a block of texts: a row per character of each different word, a column per piece length."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        self.vocabulary = vocabulary
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        self.sizes = np.array([len(t) for t in marked], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        n = len(self.data)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        first = np.zeros(n + 1, bool)
        first[(self.ends - self.sizes)[self.sizes > 0]] = True
        for c in vocabulary.breaks:
            own = self.data == ord(c)
            first[:-1] |= own & ~np.append(False, own[:-1]) if c == SPACE else own
            if c != SPACE:
                first[1:] |= own
        self.start = np.flatnonzero(first[:n])
        self.end = np.append(self.start[1:], n) if n else self.start
        hashes = char_span(char_prefix(self.data), self.start, self.end)
        _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
        size = (self.end - self.start)[one]
        base = np.cumsum(size + 1) - (size + 1)
        self.row = np.repeat(base[kind] - self.start, self.end - self.start) + np.arange(n)
        self.word_end = np.repeat(self.end, self.end - self.start)
        self._build(self.start[one], size, base)

    def _build(self, start: np.ndarray, size: np.ndarray, base: np.ndarray) -> None:
        v = self.vocabulary
        total, longest = int((size + 1).sum()), max(v.by_length)
        place = np.repeat(start - base, size + 1) + np.arange(total)
        left = np.repeat(base + size, size + 1) - np.arange(total)  # characters to the word's end
        weight, ids = np.full((total, longest), -np.inf), np.full((total, longest), -1, np.int32)
        prefix = char_prefix(self.data)
        open_ = np.flatnonzero(left >= 1)  # rows whose characters begin some piece
        for length in range(1, longest + 1):
            open_ = open_[left[open_] >= length]
            h = raw_span(prefix, place[open_], place[open_] + length)
            filtered = _place(h)
            begun = v.begins[length][filtered]
            maybe = np.flatnonzero(v.seen[filtered]) if length in v.by_length else begun[:0].nonzero()[0]
            if len(maybe):
                hashes, piece_ids, weights = v.by_length[length]
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                hit = hashes[at] == h[maybe]
                rows = open_[maybe[hit]]
                weight[rows, length - 1], ids[rows, length - 1] = weights[at[hit]], piece_ids[at[hit]]
            open_ = open_[begun]
        lost = np.flatnonzero((left >= 1) & (ids[:, 0] < 0))
        c = self.data[place[lost]]
        weight[lost, 0] = v.byte_weight * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        back = np.zeros(total)
        order = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for d in range(1, len(cuts)):
            rows = order[cuts[d - 1]:cuts[d]]
            if len(rows):
                reach = min(d, longest)
                sums = weight[rows, :reach] + back[rows[:, None] + np.arange(1, reach + 1)]
                top = sums.max(axis=1)
                back[rows] = top + np.log(np.exp(sums - top[:, None]).sum(axis=1))
        # Steps: the possible pieces of each row, one after another.
        row, column = np.nonzero(np.isfinite(weight))
        self.length = column + 1
        self.id = ids[row, column]
        self.log = weight[row, column] + back[row + column + 1] - back[row]
        chance = np.exp(self.log)
        self.first = np.searchsorted(row, np.arange(total + 1))
        running = np.append(0.0, np.cumsum(chance))
        before = running[self.first[:-1]]
        whole = np.diff(running[self.first])
        self.chance, self.upto = chance / whole[row], (running[1:] - before[row]) / whole[row]
        self.upto[self.first[1:][np.diff(self.first) > 0] - 1] = 1.0
        alone = np.diff(self.first)[row] == 1
        rest = np.where(alone, 0.0, 1 - self.chance)
        # Of nearly certain steps, the sum of the others is exact where one minus their chance is not.
        sure = np.flatnonzero((rest < 1e-6) & ~alone)
        if len(sure):
            others = chance.copy()
            others[sure] = 0
            filled = np.flatnonzero(np.diff(self.first))
            sums = np.zeros(total)
            sums[filled] = np.add.reduceat(others, self.first[filled])
            rest[sure] = sums[row[sure]]
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(rest)

    def pick(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The step taken at each place for a uniform number."""
        step = self.first[self.row[at]]
        open_ = np.flatnonzero(u >= self.upto[step])
        while len(open_):
            step[open_] += 1
            open_ = open_[u[open_] >= self.upto[step[open_]]]
        return step

    def draw(self, path: np.ndarray, at: np.ndarray, noise) -> None:
        """Follow the lattice from places ``at`` to the ends of their words; writes steps plus one into ``path``."""
        while len(at):
            step = self.pick(at, noise(at))
            path[at] = step + 1
            at = at + self.length[step]
            at = at[at < self.word_end[at - 1]]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def sample(lattice: Lattice, seeds: np.ndarray, k: int = SAMPLES):
    """Paths (k, characters) of steps plus one, log probabilities, perturbed values (-inf: no such sample) and kappa per text."""
    n, texts = len(lattice.data), len(lattice.sizes)
    begin = lattice.ends - lattice.sizes
    seed = seeds.astype(U64)[lattice.owner] + (np.arange(n) - begin[lattice.owner]).astype(U64) * U64(0x9E3779B97F4A7C15)

    def noise(s: int, kind: int):
        return lambda at: _uniform(seed[at] ^ U64((s + 1) * 0xC2B2AE3D27D4EB4F + kind * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF))

    def bounded(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The largest of Gumbel values with the given log mass, known to be below the bound."""
        with np.errstate(divide="ignore"):
            return np.where(np.isneginf(mass), -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - np.where(np.isneginf(mass), 0, mass)))

    paths, values, logs = np.zeros((k, n), np.int32), np.full((k, texts), -np.inf), np.full((k, texts), -np.inf)
    opened: list[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]] = []  # places, log p before, steps taken from them, values

    def close(s: int, bound: np.ndarray, after: np.ndarray) -> None:
        """Log probability of path ``s`` and its open nodes past ``after``."""
        at = np.flatnonzero(paths[s])
        chosen, owner = paths[s][at] - 1, lattice.owner[at]
        step = lattice.log[chosen]
        running = np.cumsum(step)
        last = np.searchsorted(at, lattice.ends) - 1
        sums = np.where(last >= 0, running[last] if len(at) else 0.0, 0.0)
        before_text = np.where(begin > 0, np.append(0.0, running)[np.searchsorted(at, begin)], 0.0)
        before = running - step - before_text[owner]
        live = ~np.isneginf(values[s])
        logs[s] = np.where(live, sums - before_text, -np.inf)
        mass = before + lattice.log_rest[chosen]
        open_ = (at > after[owner]) & live[owner]
        value = np.full(len(at), -np.inf)
        value[open_] = bounded(mass[open_], bound[owner[open_]], noise(s, 2)(at[open_]))
        opened.append((at, before, [chosen], value))

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text the largest open value, its path and the place of its node in the path's list."""
        top, path, node = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for s, (at, _, _, value) in enumerate(opened):
            if not len(at):
                continue
            cut = np.searchsorted(at, begin)
            some = np.flatnonzero(np.diff(np.append(cut, len(at))) > 0)
            highest = np.maximum.reduceat(value, cut[some])
            better = highest > top[some]
            own = some[better]
            top[own], path[own] = highest[better], s
            spans = np.diff(np.append(cut[some], len(at)))
            hit = np.flatnonzero(value == np.repeat(highest, spans))[::-1]
            place = np.zeros(texts, np.int64)
            place[lattice.owner[at[hit]]] = hit  # the first of equal ones
            node[own] = place[own]
        return top, path, node

    some = lattice.sizes > 0
    values[0] = np.where(some, -np.log(-np.log(_uniform(seeds.astype(U64) ^ U64(0xA0761D6478BD642F)))), -np.inf)
    lattice.draw(paths[0], lattice.start, noise(0, 1))
    close(0, values[0], np.full(texts, -1))
    for s in range(1, k):
        top, path, node = best()
        go = np.flatnonzero(~np.isneginf(top))
        values[s, go] = top[go]
        after = np.full(texts, n)
        fresh = np.zeros(n, bool)
        for p in range(s):
            own = go[path[go] == p]
            if not len(own):
                continue
            at, before, taken, value = opened[p]
            i = node[own]
            place = at[i]
            after[own] = place
            # One node of each text: its steps side by side, without those that were taken before.
            lo, hi = lattice.first[lattice.row[place]], lattice.first[lattice.row[place] + 1]
            steps = np.minimum(lo[:, None] + np.arange(int((hi - lo).max())), hi[:, None] - 1)
            free = np.where(lo[:, None] + np.arange(steps.shape[1]) < hi[:, None], lattice.chance[steps], 0.0)
            for t in taken:
                free[steps == t[i][:, None]] = 0
            total = np.cumsum(free, axis=1)
            pick = np.minimum((total <= (noise(s, 3)(place) * total[:, -1])[:, None]).sum(axis=1), free.shape[1] - 1)
            pick = np.where(free[np.arange(len(pick)), pick] > 0, pick, free.argmax(axis=1))
            step = steps[np.arange(len(pick)), pick]
            more = taken[0].copy()
            more[i] = step
            taken.append(more)
            free[np.arange(len(pick)), pick] = 0
            rest = free.sum(axis=1)
            with np.errstate(divide="ignore"):
                mass = np.where(rest > 0, before[i] + np.log(rest), -np.inf)
            value[i] = bounded(mass, top[own], noise(s, 4)(place))
            mine = np.isin(lattice.owner, own) if len(own) < texts else np.ones(n, bool)
            early = mine & (np.arange(n) < after[lattice.owner])
            paths[s][early] = paths[p][early]
            paths[s][place] = step + 1
            fresh |= mine & (np.arange(n) > after[lattice.owner])
        begins = lattice.start[fresh[lattice.start]]
        follow = after[go] + lattice.length[paths[s][after[go]] - 1]
        follow = follow[follow < lattice.word_end[after[go]]]
        # The rest of the word in which the path leaves its parent, then all later words.
        lattice.draw(paths[s], np.concatenate([follow, begins]), noise(s, 1))
        close(s, top, after)
    kappa = best()[0]
    return paths, logs, values, kappa


def path_ids(lattice: Lattice, path: np.ndarray) -> list[np.ndarray]:
    """Piece ids of every text along a path, bytes for characters outside the vocabulary."""
    at = np.flatnonzero(path)
    ids = lattice.id[path[at] - 1]
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        raw = [lattice.vocabulary.byte_ids[np.frombuffer(chr(c).encode(), np.uint8)] for c in lattice.data[at[lost]].tolist()]
        extra = np.zeros(len(at), np.int64)
        extra[lost] = [len(r) - 1 for r in raw]
        where = np.arange(len(at)) + np.cumsum(extra) - extra
        out = np.zeros(len(at) + int(extra.sum()), np.int32)
        out[where] = ids
        for w, r in zip(where[lost].tolist(), raw):
            out[w:w + len(r)] = r
        ids, counts = out, 1 + extra
    else:
        counts = np.ones(len(at), np.int64)
    bounds = np.append(0, np.cumsum(counts))[np.searchsorted(at, lattice.ends)]
    return np.split(ids, bounds[:-1])


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of piece ids; bytes that are no UTF-8 become the replacement character."""
    byte_of = {int(i): b for b, i in enumerate(vocabulary.byte_ids)}
    raw = b"".join(bytes([byte_of[i]]) if i in byte_of else vocabulary.pieces[i].encode() for i in ids.tolist())
    return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """UTF-8 of every piece, with spaces for their marks; the byte itself for a byte's piece."""
    table = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
    for b, i in enumerate(vocabulary.byte_ids.tolist()):
        table[i] = bytes([b])
    return table


def decoded_bytes(table: list[bytes], ids: np.ndarray) -> bytes:
    """UTF-8 of the text that piece ids give back, without the space put before it."""
    return b"".join([table[i] for i in ids.tolist()])[1:]


def key_seeds(keys: list) -> np.ndarray:
    """A seed per row key, from its text form; all null keys have the same."""
    return mix(np.array([zlib.crc32(str(k).encode()) | (zlib.adler32(str(k).encode()) << 32) for k in keys], U64))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sampled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SAMPLES, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id, place, log_prob, perturbed, log_inclusion, n_pieces, ids_crc32, text_crc32, same_text and, unless left out, ids) per sampled segmentation.

    Up to ``k`` different segmentations per row in falling order of the perturbed value; fewer where the text has fewer, none
    for a null or empty text.  ``text_crc32`` is taken of the text that the ids decode to, ``same_text`` tells whether
    that is the row's own, byte by byte.  ``log_inclusion`` is the log of the inclusion score, 0 where all segmentations are in the sample.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        table = piece_bytes(words)
        for batch in batches:
            keys, raw = batch.column(0).to_pylist(), utf8(batch.column(1))
            texts = [t.decode() for t in raw]
            for lo, hi in blocks([len(t) for t in texts], BLOCK):
                lattice = Lattice(words, texts[lo:hi])
                paths, logs, values, kappa = sample(lattice, key_seeds(keys[lo:hi]), k)
                with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                    x = logs - kappa
                    score = np.where(np.isneginf(kappa), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50))))))
                for s in range(k):
                    some = np.flatnonzero(~np.isneginf(values[s]))
                    ids = path_ids(lattice, paths[s])
                    out = [ids[i] for i in some]
                    back = [decoded_bytes(table, o) for o in out]
                    told = [
                        pa.array([zlib.crc32(o.astype("<u4")) for o in out], pa.int64()), pa.array([zlib.crc32(t) for t in back], pa.int64()),
                        pa.array([t == raw[lo + i] for t, i in zip(back, some.tolist())], pa.bool_())]
                    if with_ids:
                        offsets = np.append(0, np.cumsum([len(o) for o in out])).astype(np.int32)
                        told.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(np.full(len(some), s, np.int32)), pa.array(logs[s, some]), pa.array(values[s, some]),
                         pa.array(score[s, some]), pa.array([len(o) for o in out], pa.int32()), *told],
                        [id_column, "place", "log_prob", "perturbed", "log_inclusion", "n_pieces", "ids_crc32", "text_crc32", "same_text", *(["ids"] if with_ids else [])])

    kind = docs.schema[id_column].dataType.simpleString()
    last = "ids_crc32 long, text_crc32 long, same_text boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(id_column, text_column).mapInArrow(
        run, f"`{id_column}` {kind}, place int, log_prob double, perturbed double, log_inclusion double, n_pieces int, {last}")


def decoded(samples: DataFrame, path: str | None = None, ids_column: str = "ids") -> DataFrame:
    """``samples`` with a column ``decoded``: the text of its piece ids; null for null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [None if v is None else decode(words, np.array(v, np.int32)) for v in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInArrow(run, f"{fields}, decoded string")
