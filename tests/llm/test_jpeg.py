import hashlib
import random
import zlib

import numpy as np

from lodestone.llm import jpeg


def test_round_trip_of_any_bytes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 191, 192, 193, 384, 5000, 300_000):
        payload = jpeg.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(payload) % 192 == 0 and len(payload) >= 192
        assert jpeg.payload_of(jpeg.decode(jpeg.encode(payload))) == payload


def _write(symbols_of, planes, scans):
    """A progressive file of one component with run lengths, end-of-block runs and new coefficients in refinements."""
    parts = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0] + [2] * 64))]
    rows, columns = planes.shape[:2]
    parts.append(jpeg._segment(0xC2, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * columns).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])))
    codes = {8: tuple(range(0, 250))}
    code_of = {s: format(i, "08b") for i, s in enumerate(codes[8])}
    parts.append(jpeg._table(0, 0, codes) + jpeg._table(1, 0, codes))
    for first, last, high, low in scans:
        bits = symbols_of(planes.reshape(-1, 64), code_of, first, last, high, low)
        bits += "1" * (-len(bits) % 8)
        parts.append(jpeg._scan([(1, 0)], first, last, high, low, int(bits, 2).to_bytes(len(bits) // 8, "big")))
    return b"".join([*parts, b"\xff\xd9"])


def _number(v):
    size = abs(v).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def _symbols(blocks, code_of, first, last, high, low):
    out, before = [], 0
    if first == 0:
        for b in blocks:
            if high:
                out.append(str((int(b[0]) >> low) & 1))
            else:
                v = int(b[0]) >> low
                size, bits = _number(v - before)
                out.append(code_of[size] + bits)
                before = v
        return "".join(out)
    for b in blocks:
        now = [int(abs(x)) >> low for x in b]
        old = [int(abs(x)) >> high if high else 0 for x in b]
        zeros, pending = 0, ""
        for k in range(first, last + 1):
            if old[k]:
                pending += str(now[k] & 1)
            elif now[k]:
                sign = b[k] > 0
                if high:
                    out.append(code_of[zeros << 4 | 1] + ("1" if sign else "0") + pending)
                else:
                    size, bits = _number(now[k] if sign else -now[k])
                    out.append(code_of[zeros << 4 | size] + bits)
                zeros, pending = 0, ""
            else:
                zeros += 1
                if zeros == 16 and any(now[j] and not old[j] for j in range(k + 1, last + 1)):
                    out.append(code_of[0xF0] + pending)
                    zeros, pending = 0, ""
        if zeros or pending:
            out.append(code_of[0] + pending)
    return "".join(out)


def test_general_scans_with_runs_and_refinements():
    rng = random.Random(8)
    planes = np.zeros((2, 3, 64), np.int32)
    for b in planes.reshape(-1, 64):
        b[0] = rng.randint(-200, 200)
        for k in rng.sample(range(1, 64), rng.choice([0, 3, 20])):
            b[k] = rng.choice([-9, -2, -1, 1, 2, 5, 13])
    scans = [(0, 0, 0, 1), (1, 10, 0, 2), (11, 63, 0, 1), (1, 10, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
    image = jpeg.decode(_write(_symbols, planes, scans))
    assert (image.planes[0] == planes).all()
    # Samples against the definition of the transform.
    c, x = np.arange(8), np.arange(8)
    basis = np.cos((2 * x[None] + 1) * c[:, None] * np.pi / 16) * np.where(c == 0, 8 ** -0.5, 0.5)[:, None]
    rgb = jpeg.tensor(image)
    for r in range(2):
        for k in range(3):
            square = np.zeros(64)
            square[jpeg.ZIGZAG] = 2 * planes[r, k]
            want = np.clip(basis.T @ square.reshape(8, 8) @ basis + 128, 0, 255)
            assert np.abs(rgb[8 * r:8 * r + 8, 8 * k:8 * k + 8, 0] - want).max() <= 0.51


def test_query_over_a_table(spark, tmp_path):
    from lodestone.llm.queries import op8_progressive_jpeg

    rows = [(0, "plain"), (1, None), (2, ""), (3, "é" * 5000), (4, "plain"), (5, "a" * 192)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_progressive_jpeg(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > len(payload) and len(r.media_sha256) == 64
    assert got[0][1:] == got[4][1:] and got[1][1:] == got[2][1:]


def test_pixels_are_the_tensors_of_the_media(spark):
    rows = [(1, "some text"), (2, None), (3, "é" * 700)]
    media = jpeg.stored(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    want = {r.doc_id: jpeg.tensor(jpeg.decode(bytes(r.media))) for r in media.collect()}
    got = {r.doc_id: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in jpeg.pixels(media).collect()}
    assert got.keys() == want.keys() and all((got[i] == want[i]).all() for i in want)
