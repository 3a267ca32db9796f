"""Media columns as progressive JPEG.

``encode`` stores bytes losslessly as quantized transform coefficients: the DC coefficient of a block is a byte less 128, an AC
coefficient is the value whose eight magnitude bits are the byte (-255..-128 and 128..255).  Images are YCbCr with chroma
halved both ways, coded in the scans of a progressive file: DC without its lowest bit, two spectral bands of AC without their
lowest bit, then one refinement of the DC and of each component's AC coefficients.

``decode`` reads progressive files: it accumulates spectral selection and successive approximation scans into coefficient
arrays, for any Huffman tables.  A scan whose AC table holds a single code has the same layout in every block and is read by
numpy at once; other scans are read bit by bit.  ``tensor`` transforms coefficients back in numpy with integer-valued
arithmetic, so equal files give equal pixels, repeats chroma samples and returns full-resolution RGB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import utf8

UNIT = 192  # payloads are padded to a multiple of three blocks
MCU = 384  # bytes that four luma and two chroma blocks hold
WIDE = 4095  # units that a row of an image can hold
SLICE = 512  # units transformed back at once
BANDS = ((1, 5), (6, 63))

# Sampling factors, and the Huffman tables (symbols by code length) that the encoder writes.
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
DC_CODES = {4: tuple(range(9))}
FIRST_CODES = {1: (0x07,)}
REFINE_CODES = {1: (0x00,)}


def _zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in scan order: along diagonals, turning at each edge."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


SHIFT = 16  # fraction bits of the basis


def _basis() -> np.ndarray:
    """64 x 64: samples of a block from its coefficients in scan order, scaled to integers."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    one[0] /= 2 ** 0.5
    return np.rint(np.kron(one, one)[ZIGZAG] * (1 << SHIFT))


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, place: int, codes: dict[int, tuple[int, ...]]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | place, *(len(codes.get(n, ())) for n in range(1, 17)), *(s for n in sorted(codes) for s in codes[n])]))


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(b for c, t in components for b in (c, t)), first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of different bit sizes one after another, the last byte filled with ones."""
    total = int(sizes.sum())
    start = np.cumsum(sizes) - sizes
    at = np.repeat(start, sizes)
    out = np.ones(-(-total // 8) * 8, np.uint8)
    place = np.arange(total)
    out[:total] = (np.repeat(values, sizes) >> (np.repeat(sizes, sizes) - 1 - (place - at))) & 1
    return np.packbits(out).tobytes()


def _raster(units: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the luma blocks in raster order: unit and block in the unit."""
    high = units // wide
    r, c = np.meshgrid(np.arange(2 * high), np.arange(2 * wide), indexing="ij")
    return ((r // 2) * wide + c // 2).ravel(), ((r % 2) * 2 + c % 2).ravel()


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload; its length stands in a comment."""
    units = max(1, -(-len(payload) // MCU))
    rows = -(-units // WIDE)
    wide = -(-units // rows)
    units = rows * wide
    data = np.frombuffer(payload.ljust(units * MCU, b"\0"), np.uint8).reshape(units, 6, 64)
    unit, block = _raster(units, wide)
    planes = [data[unit, block], data[:, 4], data[:, 5]]
    high = 16 * rows

    parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0] + [1] * 64))]
    parts.append(_segment(0xC2, struct.pack(">BHHB", 8, high, 16 * wide, 3) + bytes(b for i, h, v in COMPONENTS for b in (i, h << 4 | v, 0))))
    parts.append(_table(0, 0, DC_CODES) + _table(1, 0, FIRST_CODES) + _table(1, 1, REFINE_CODES))

    dc = data[:, :, 0].astype(np.int64) - 128
    top = dc >> 1
    order = top.copy()
    order[:, 1:4] -= top[:, 0:3]
    order[1:, 0] -= top[:-1, 3]
    order[1:, 4:] -= top[:-1, 4:]
    diff = order.ravel()
    size = np.zeros(len(diff), np.int64)
    for k in range(8):
        size += np.abs(diff) >= 1 << k
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    parts.append(_scan([(i, 0) for i, _, _ in COMPONENTS], 0, 0, 0, 1, _bits((size << size) | value, 4 + size)))
    for first, last in BANDS:
        for (i, _, _), plane in zip(COMPONENTS, planes):
            # Code 0 and seven bits: the byte without its lowest bit, whether the coefficient is negative or not.
            parts.append(_scan([(i, 0)], first, last, 0, 1, (plane[:, first:last + 1] >> 1).tobytes()))
    parts.append(_scan([(i, 0) for i, _, _ in COMPONENTS], 0, 0, 1, 0, np.packbits(np.append((dc.ravel() & 1).astype(np.uint8), np.ones(-dc.size % 8, np.uint8))).tobytes()))
    for (i, _, _), plane in zip(COMPONENTS, planes):
        low = np.zeros((len(plane), 64), np.uint8)  # the end-of-block code, then a correction bit for every coefficient
        low[:, 1:] = (plane[:, 1:] & 1) ^ (plane[:, 1:] < 128)
        parts.append(_scan([(i, 1)], 1, 63, 1, 0, np.packbits(low).tobytes()))
    return b"".join([*parts, b"\xff\xd9"])


class _Reader:
    """Bits of one entropy-coded scan."""

    def __init__(self, data: bytes):
        self.array, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def bits(self, n: int) -> int:
        out = 0
        for b in self.array[self.at:self.at + n]:
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.array[self.at]
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code in the scan")

    def signed(self, n: int) -> int:
        v = self.bits(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@dataclass
class Image:
    height: int
    width: int
    comments: list[bytes]
    sampling: list[tuple[int, int]]  # by component
    planes: list[np.ndarray]  # (block rows, block columns, 64) coefficients in scan order
    quantizers: list[np.ndarray]


def _codes(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        counts, symbols, code, codes = body[at + 1:at + 17], at + 17, 0, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                codes[n, code] = body[symbols]
                symbols, code = symbols + 1, code + 1
            code <<= 1
        yield body[at], codes
        at = symbols


def decode(data: bytes) -> Image:
    """Coefficients of a progressive file; raises ValueError for other kinds of file and for restart intervals."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, tables, quantizers, ids, chosen = 2, None, {}, {}, [], []
    comments: list[bytes] = []
    while True:
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 2 if body[k] >> 4 else 1
                quantizers[body[k] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, k + 1).astype(np.float64)
                k += 1 + 64 * wide
        elif marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            specs = [body[6 + 3 * k:9 + 3 * k] for k in range(n)]
            ids, chosen = [s[0] for s in specs], [s[2] for s in specs]
            sampling = [(s[1] >> 4, s[1] & 15) for s in specs]
            rows, columns = -(-height // (8 * max(v for _, v in sampling))), -(-width // (8 * max(h for h, _ in sampling)))
            image = Image(height, width, comments, sampling, [np.zeros((rows * v, columns * h, 64), np.int32) for h, v in sampling], [])
        elif marker in (0xC0, 0xC1, 0xC3, 0xDD):
            raise ValueError("not a progressive file without restarts")
        elif marker == 0xDA:
            n = body[0]
            parts = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            first, last, step = body[1 + 2 * n:4 + 2 * n]
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1]:
                    break
                end += 2
            _read_scan(image, parts, tables, first, last, step >> 4, step & 15, data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
        if data[at:at + 2] == b"\xff\xd9":
            break
    image.quantizers = [quantizers[q] for q in chosen]
    return image


def _read_scan(image: Image, parts, tables, first: int, last: int, high: int, low: int, data: bytes) -> None:
    if first == 0:
        _read_dc(image, parts, tables, high, low, data)
        return
    index, places = parts[0]
    h, v = image.sampling[index]
    tall, wide = (-(-image.height * v // (8 * max(y for _, y in image.sampling))), -(-image.width * h // (8 * max(x for x, _ in image.sampling))))
    plane, codes = image.planes[index], tables[16 + (places & 15)]
    if len(codes) == 1:
        (length, _), symbol = next(iter(codes.items()))
        whole = plane[:tall, :wide].reshape(-1, 64)
        if high == 0 and symbol >> 4 == 0 and symbol & 15:
            size, n = symbol & 15, len(whole) * (last - first + 1)
            if length + size == 8:
                value = np.frombuffer(data, np.uint8, n).astype(np.int32) & ((1 << size) - 1)
            else:
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (length + size)).reshape(n, length + size)
                value = bits[:, length:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            value -= ((1 << size) - 1) * (value < 1 << (size - 1))
            value <<= low
            whole[:, first:last + 1] = value.reshape(len(whole), -1)
            plane[:tall, :wide] = whole.reshape(tall, wide, 64)
            return
        if high and symbol == 0:
            # Every block is the end-of-block code and a bit for each coefficient that is not zero yet.
            band = whole[:, first:last + 1]
            known = band != 0
            if known.all():
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(band) * (band.shape[1] + length))
                fix = bits.reshape(len(band), -1)[:, length:].astype(np.int32) << low
                band += np.where(band > 0, fix, -fix)
            else:
                sizes = known.sum(axis=1) + length
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=int(sizes.sum()))
                code = (np.cumsum(sizes) - sizes)[:, None] + np.arange(length)
                rest = np.ones(len(bits), bool)
                rest[code] = False
                band[known] += np.where(band[known] > 0, 1, -1) * (bits[rest].astype(np.int32) << low)
            whole[:, first:last + 1] = band
            plane[:tall, :wide] = whole.reshape(tall, wide, 64)
            return
    reader, run = _Reader(data), 0
    for r in range(tall):
        for c in range(wide):
            read = _first_block if high == 0 else _refined_block
            run = read(reader, codes, plane[r, c], first, last, low, run)


@lru_cache(maxsize=8)
def _lookup(codes: tuple) -> list[tuple[int, int]]:
    """Length and symbol of the code that 16 bits begin with."""
    look = [(16, 0)] * (1 << 16)
    for (length, code), symbol in codes:
        look[code << (16 - length):(code + 1) << (16 - length)] = [(length, symbol)] * (1 << (16 - length))
    return look


def _read_dc(image: Image, parts, tables, high: int, low: int, data: bytes) -> None:
    """The DC coefficients of one or all components, unit by unit."""
    planes, order = [image.planes[i] for i, _ in parts], []
    if len(parts) == 1:
        (i, _), (h, v) = parts[0], image.sampling[parts[0][0]]
        tall, wide = (-(-image.height * v // (8 * max(y for _, y in image.sampling))), -(-image.width * h // (8 * max(x for x, _ in image.sampling))))
        r, c = np.divmod(np.arange(tall * wide), wide)
        order = [np.zeros(len(r), np.int64), r, c]
    else:
        h, v = image.sampling[parts[0][0]]
        columns, rows = planes[0].shape[1] // h, planes[0].shape[0] // v
        ur, uc = (x[:, None] for x in np.divmod(np.arange(rows * columns), columns))
        # Component, row and column in the unit, height and width of the component's share of a unit.
        each = np.array([(k, a, b, image.sampling[i][1], image.sampling[i][0]) for k, (i, _) in enumerate(parts) for a in range(image.sampling[i][1]) for b in range(image.sampling[i][0])]).T
        order = [np.broadcast_to(each[0], (len(ur), len(each[0]))).ravel(), (ur * each[3] + each[1]).ravel(), (uc * each[4] + each[2]).ravel()]
    n = len(order[0])
    if high:
        values = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int32) << low
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        padded = np.concatenate([bits, np.ones(32, np.uint8)]).astype(np.int64)
        window = np.zeros(len(bits) + 16, np.int64)
        for b in range(16):
            window = window << 1 | padded[b:b + len(window)]
        lookups, steps, diffs = [], window.tolist(), []
        for _, places in parts:
            lookups.append(_lookup(tuple(tables[places >> 4].items())))
        at, which = 0, order[0].tolist()
        for k in which:
            length, size = lookups[k][steps[at]]
            at += length
            if size:
                v = steps[at] >> (16 - size)
                diffs.append(v if v >> (size - 1) else v - (1 << size) + 1)
                at += size
            else:
                diffs.append(0)
        values, diffs = np.zeros(n, np.int32), np.array(diffs, np.int32)
        for k in range(len(parts)):
            own = order[0] == k
            values[own] = np.cumsum(diffs[own]) << low
    for k, plane in enumerate(planes):
        own = order[0] == k
        plane[order[1][own], order[2][own], 0] |= values[own]


def _first_block(reader: _Reader, codes, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
    """One block of a first AC scan; returns the blocks that are still to be skipped."""
    if run:
        return run - 1
    k = first
    while k <= last:
        symbol = reader.symbol(codes)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = reader.signed(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + (reader.bits(zeros) if zeros else 0) - 1
    return 0


def _refined_block(reader: _Reader, codes, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
    """One block of a refining AC scan: new coefficients of one unit, and a correction bit for each known one passed."""
    one, k = 1 << low, first

    def correct(i: int) -> None:
        if reader.bits(1):
            block[i] += one if block[i] > 0 else -one

    while not run and k <= last:
        symbol = reader.symbol(codes)
        zeros, size = symbol >> 4, symbol & 15
        new = 0
        if size:
            new = one if reader.bits(1) else -one
        elif zeros < 15:
            run = (1 << zeros) + (reader.bits(zeros) if zeros else 0)
            break
        while k <= last:
            if block[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                if new:
                    block[k] = new
                k += 1
                break
            k += 1
    if run:
        for i in range(k, last + 1):
            if block[i]:
                correct(i)
        return run - 1
    return 0


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` stored, from the coefficients."""
    size = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
    luma, blue, red = image.planes
    units, wide = blue.shape[0] * blue.shape[1], blue.shape[1]
    unit, block = _raster(units, wide)
    out = np.empty((units, 6, 64), np.int32)
    out[unit, block] = luma.reshape(-1, 64)
    out[:, 4], out[:, 5] = blue.reshape(-1, 64), red.reshape(-1, 64)
    ac = out[:, :, 1:]
    ac[ac < 0] += 255
    out[:, :, 0] += 128
    return out.astype(np.uint8).tobytes()[:size]


def tensor(image: Image) -> np.ndarray:
    """(height, width, 3) RGB samples."""
    top_h, top_v = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    full = []
    for (h, v), plane, quantizer in zip(image.sampling, image.planes, image.quantizers):
        rows, columns = plane.shape[:2]
        flat, samples = plane.reshape(-1, 64), np.empty((rows * columns, 64), np.uint8)
        for lo in range(0, len(flat), 4 * SLICE):
            s = (flat[lo:lo + 4 * SLICE] * quantizer) @ BASIS  # whole numbers below 2^53: exact in any order
            samples[lo:lo + 4 * SLICE] = np.clip((s.astype(np.int64) + (128 << SHIFT) + (1 << (SHIFT - 1))) >> SHIFT, 0, 255)
        whole = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        full.append(whole.repeat(top_v // v, axis=0).repeat(top_h // h, axis=1)[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0][..., None], 3, axis=2)
    y, cb, cr = (p.astype(np.int32) for p in full)
    cb -= 128
    cr -= 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    # 1.402, 0.344136, 0.714136 and 1.772 in units of 1 / 65536.
    out[..., 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
    out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, channel means in thousandths and a checksum of the pixels."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    n = rgb.shape[0] * rgb.shape[1]
    return ":".join([f"{rgb.shape[0]}x{rgb.shape[1]}", *(str(int(1000 * s // n)) for s in sums), f"{zlib.crc32(np.ascontiguousarray(rgb)):08x}"])


def padded(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of ``UNIT``."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def stored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text, null as empty, as a progressive JPEG."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo in range(0, len(texts), 256):
                own = texts[lo:lo + 256]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(own)), pa.array([len(t) for t in own], pa.int64()), pa.array([encode(padded(t)) for t in own], pa.binary())],
                    [id_column, "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, media binary")


def pixels(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, height, width, rgb): the full-resolution RGB tensor of every media value; a null one has null columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in enumerate(batch.column(1).to_pylist()):
                t = None if m is None else tensor(decode(m))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([None if t is None else t.shape[0]], pa.int32()), pa.array([None if t is None else t.shape[1]], pa.int32()),
                     pa.array([None if t is None else t.tobytes()], pa.binary())], [id_column, "height", "width", "rgb"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "media").mapInArrow(run, f"`{id_column}` {kind}, height int, width int, rgb binary")
