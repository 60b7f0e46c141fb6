"""Media against decoders and encoders written apart from the operator, bit by bit."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from depscope.llm import media

# --- a plain reader of AVI and of lossless frames


def avi_frames(data):
    """Frames of an AVI by walking its movi list."""
    at = data.index(b"movi") + 4
    out = []
    while data[at : at + 4] == b"00dc":
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def lossless(data):
    """Samples of one lossless frame: Huffman codes one bit at a time, predictor 1, a row a restart interval."""
    bits_of, codes, at = {}, {}, 2
    while data[at + 1] != 0xDA:
        size = data[at + 2] * 256 + data[at + 3]
        bits_of[data[at + 1]] = data[at + 4 : at + 2 + size]
        at += 2 + size
    at += 2 + data[at + 2] * 256 + data[at + 3]
    table, code, k = bits_of[0xC4], 0, 17
    for length in range(1, 17):
        for _ in range(table[length]):
            codes[f"{code:0{length}b}"] = table[k]
            code, k = code + 1, k + 1
        code *= 2
    height, width = struct.unpack(">HH", bits_of[0xC3][1:5])
    rows, bits = [], ""
    while data[at : at + 2] != b"\xff\xd9":
        if data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7:
            rows.append(bits)
            bits, at = "", at + 2
        elif data[at] == 0xFF:
            bits, at = bits + "1" * 8, at + 2
        else:
            bits, at = bits + f"{data[at]:08b}", at + 1
    rows.append(bits)
    assert len(rows) == height
    out = b""
    for bits in rows:
        before, k, line = 128, 0, []
        while len(line) < width:
            end = k + 1
            while bits[k:end] not in codes:
                end += 1
            size = codes[bits[k:end]]
            k = end + size
            extra = bits[end:k]
            step = 0 if not size else int(extra, 2) if extra[0] == "1" else int(extra, 2) - 2**size + 1
            before = before + step & 0xFF
            line.append(before)
        out += bytes(line)
    return out


def payloads():
    rng = random.Random(8)
    return [rng.randbytes(64 * rng.randrange(1, 30)) for _ in range(12)] + [b"\xff" * 640, b"\0" * 64, bytes([0, 255]) * 1056, b"plain words " * 16]


def test_another_decoder_reads_the_payload():
    for payload, data in zip(payloads(), media.store(payloads()), strict=True):
        assert b"".join(map(lossless, avi_frames(data)))[: len(payload)] == payload
        size = data.index(b"strd")
        assert struct.unpack("<Q", data[size + 8 : size + 16])[0] == len(payload)


def test_round_trip():
    stored = media.store(payloads())
    for payload, video in zip(payloads(), media.load(stored), strict=True):
        assert b"".join(i.tobytes() for i in video.images)[: video.payload] == payload and video.error is None
    assert stored == media.store(payloads())
    without_index = stored[0][: stored[0].index(b"idx1")]
    without_index = without_index[:4] + struct.pack("<I", len(without_index) - 8) + without_index[8:]
    assert media.parse_avi(without_index).frames == media.parse_avi(stored[0]).frames


# --- a plain encoder of baseline frames


def waves():
    return np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def order():
    """Coded order of coefficients, by going up and down the diagonals."""
    out, x, y, up = [], 0, 0, True
    while len(out) < 64:
        out.append((y, x))
        if up:
            x, y, up = (x + 1, y - 1, True) if y and x < 7 else ((x + 1, y, False) if x < 7 else (x, y + 1, False))
        else:
            x, y, up = (x - 1, y + 1, False) if x and y < 7 else ((x, y + 1, True) if y < 7 else (x + 1, y, True))
    return out


def baseline(planes, factors, size, tables, restart=0):
    """A baseline frame. ``planes``: padded samples by component; ``tables``: code by symbol, for DC and AC."""
    height, width = size
    across, down = max(f[0] for f in factors), max(f[1] for f in factors)
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([2] * 64)
    for kind, (counts, symbols, _) in enumerate(tables):
        if counts is not None:
            head += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind << 4) + bytes(counts) + bytes(symbols)
    head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, height, width, len(planes))
    head += b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors))
    if restart:
        head += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes))
    head += b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + bytes([0, 63, 0])
    dc, ac = tables[0][2], tables[1][2]
    body, bits, before = b"", "", [0] * len(planes)

    def close(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def number(value):
        n = abs(value).bit_length()
        return n, format(value if value > 0 else value + 2**n - 1, f"0{n}b") if n else ""

    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            body += close(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, before = "", [0] * len(planes)
        y, x = divmod(unit, columns)
        for c, (plane, (h, v)) in enumerate(zip(planes, factors, strict=True)):
            for k in range(h * v):
                top, left = (y * v + k // h) * 8, (x * h + k % h) * 8
                own = waves() @ (plane[top : top + 8, left : left + 8] - 128.0) @ waves().T
                values = [int(round(own[p] / 2)) for p in order()]
                n, extra = number(values[0] - before[c])
                before[c] = values[0]
                bits += dc[n] + extra
                zeros = 0
                for value in values[1:]:
                    if not value:
                        zeros += 1
                        continue
                    while zeros > 15:
                        bits, zeros = bits + ac[0xF0], zeros - 16
                    n, extra = number(value)
                    bits, zeros = bits + ac[zeros << 4 | n] + extra, 0
                if zeros:
                    bits += ac[0]
    return head + body + close(bits) + b"\xff\xd9"


def flat_table(symbols):
    """Codes of eight bits for all symbols."""
    return [0] * 7 + [len(symbols)] + [0] * 8, symbols, {s: f"{k:08b}" for k, s in enumerate(symbols)}


FLAT = [flat_table(list(range(12))), flat_table([0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))])]


def picture(height, width, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    return np.clip(128 + 60 * np.sin(x / 5 + seed) + 40 * np.cos(y / 3) + rng.normal(0, 8, (height, width)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("size", [(16, 24), (21, 37)])
def test_baseline_frames(size, restart):
    height, width = size
    gray = picture(height, width, 1)
    padded = np.pad(gray, ((0, -height % 16), (0, -width % 16)), mode="edge")
    one = baseline([padded], [(1, 1)], size, FLAT, restart)
    got = media.jpeg.luma(one)
    assert got.shape == size and np.abs(got.astype(int) - gray).max() <= 5
    small = padded[::2, ::2]
    three = baseline([padded, small, 255 - small], [(2, 2), (1, 1), (1, 1)], size, FLAT, restart)
    assert np.abs(media.jpeg.luma(three).astype(int) - gray).max() <= 5


def test_usual_tables():
    """A flat block needs two codes of the usual luma tables: no difference is 00, end of block 1010."""
    usual = [(None, None, {0: "00"}), (None, None, {0: "1010"})]
    got = media.jpeg.luma(baseline([np.full((8, 8), 128, np.uint8)], [(1, 1)], (8, 8), usual))
    assert (got == 128).all()


def other_avi(images, rate):
    frames = [baseline([i], [(1, 1)], i.shape, FLAT) for i in images]
    data = bytearray(media.avi(frames, *images[0].shape[:1], 0, images[0].shape[1]))
    at = data.index(b"strd")
    data[at : at + 4] = b"JUNK"
    at = data.index(b"vidsMJPG")
    data[at + 20 : at + 28] = struct.pack("<II", 1001, rate * 1001)
    return bytes(data)


def test_clips_of_other_files(spark):
    dark, light = picture(24, 32, 2) // 3, 170 + picture(24, 32, 3) // 3
    film = other_avi([dark] * 5 + [light] * 6, 10)
    assert media.shots(np.concatenate([np.zeros((6, 8, 8)), np.full((6, 8, 8), 200)]).astype(np.uint8)) == [(0, 6), (6, 12)]
    good = media.store([b"words here " * 64])[0]
    rows = [(1, film, "x"), (2, None, "x"), (3, b"RIFFxxxxWAVE", "x"), (4, film[:-40], "x"), (5, good, "x"), (6, b"", "x")]
    rows += [(10 + k, film[:at] + bytes([film[at] ^ 0x5A]) + film[at + 1 :], "x") for k, at in enumerate(range(0, len(film), 97))]
    got = media.clips(spark.createDataFrame(rows, "id long, media binary, clip string")).collect()
    assert [(r["clip"], r["first_frame"], r["end_frame"], r["start_s"], r["end_s"]) for r in got if r["id"] == 1] == [(0, 0, 5, 0.0, 0.5), (1, 5, 11, 0.5, 1.1)]
    assert {r["id"] for r in got} == {r[0] for r in rows}
    for k in (2, 3, 4, 6):
        assert [(r["clip"], bool(r["error"])) for r in got if r["id"] == k] == [(None, True)]
    assert all((r["clip"] is None) == (r["error"] is not None) for r in got)
    assert media.clips(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_shots_by_content_alone():
    assert media.shots(np.zeros((1, 8, 64), np.uint8)) == [(0, 1)]
    words = ("the plain words of a text that goes on and on with small changes " * 60).encode()[:3500]
    upper = bytes(range(128, 256)) * 28
    def cut(raw):
        data = media.load(media.store([raw + b"\0" * (-len(raw) % 64)]))[0]
        return media.shots(data.images, media.content_samples(data))
    assert len(cut(words)) == 1  # not at the padding of the last frame
    assert cut(words[:2560] + upper) == [(0, 5), (5, 12)]


def test_stored_and_read(spark):
    rows = [(1, "text " * 3000, "old"), (2, None, "old"), (3, "", "old"), (4, "é" * 40, "old"), (5, "text " * 3000, "old")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in media.stored_and_read(frame).collect()}
    for k, text, _ in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[k]["n_bytes"], got[k]["payload_bytes"]) == (len(raw), len(padded))
        assert got[k]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and got[k]["tail_crc32"] == zlib.crc32(padded[-64:])
    assert [got[1][c] for c in got[1].__fields__[1:]] == [got[5][c] for c in got[5].__fields__[1:]]
    assert media.stored_and_read(frame.limit(0)).collect() == [] and media.clips(media.as_media(frame)).count() >= len(rows)
