"""Bytes as motion-JPEG video in AVI, and timed clips of such video.

A payload is stored in frames of up to 8 rows of 64 eight-bit samples, each frame a lossless
JPEG (sequential lossless process, predictor 1, one component) whose restart intervals are
the rows, so rows decode independently: a batch of rows is coded and decoded in lockstep,
one sample of every row at a time. The AVI has the usual headers, a ``strd`` chunk with the
payload's length, the frames as ``00dc`` chunks and an ``idx1`` index.

Other files' frames may be baseline JPEG of one or three components, with or without tables of
their own (``llm/jpeg.py``); their luma is what shots are looked for in. Times follow the file's frame rate.

Shots are cut where the difference of two frames' histograms is above what chance makes of
frames of their sizes, and far above what the frames just before differ by. Rows that pad the last
frame and zeros at a payload's end count in no histogram.

Defined results: a null text is an empty payload, stored as 64 zero bytes; equal texts give
equal media and values; an empty table gives an empty result; a media value that is null, no AVI
or damaged has one row without a clip and with the error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.llm import jpeg
from depscope.llm.arrow import add_columns, unused

WIDTH = 64
ROWS = 8
FPS = 25
BINS = 64

#: Fixed values of the JPEG standard: the usual table for differences, codes per length and symbols.
CODES_PER_LENGTH = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
SYMBOLS = tuple(range(12))


TABLE = jpeg.canonical(CODES_PER_LENGTH, SYMBOLS)
CODE = np.array([c for _, c, _ in TABLE], np.int64)
LENGTH = np.array([n for _, _, n in TABLE], np.int64)
CATEGORY = np.array([int(d).bit_length() for d in range(512)], np.int64)
RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def code_rows(rows: np.ndarray) -> list[bytes]:
    """Each row of samples as an entropy-coded segment, padded with ones and stuffed."""
    count = len(rows)
    values = rows.astype(np.int16)
    steps = np.empty_like(values)
    steps[:, 0] = values[:, 0] - 128
    steps[:, 1:] = values[:, 1:] - values[:, :-1]
    stride = WIDTH * 2
    out = np.zeros(count * stride, np.uint8)
    place = np.arange(count, dtype=np.int64) * (stride * 8)
    for k in range(WIDTH):
        step = steps[:, k].astype(np.int64)
        size = CATEGORY[np.abs(step)]
        bits = LENGTH[size] + size
        value = CODE[size] << size | np.where(step < 0, step + (1 << size) - 1, step)
        at = place >> 3
        value <<= 24 - bits - (place & 7)
        out[at] |= (value >> 16).astype(np.uint8)
        out[at + 1] |= (value >> 8 & 255).astype(np.uint8)
        out[at + 2] |= (value & 255).astype(np.uint8)
        place += bits
    rest = (-place) & 7
    ends = place + rest - np.arange(count, dtype=np.int64) * (stride * 8) >> 3
    last = (place + rest >> 3) - 1
    out[last] |= ((1 << rest) - 1).astype(np.uint8)
    raw = out.tobytes()
    return [raw[k * stride : k * stride + n].replace(b"\xff", b"\xff\x00") for k, n in enumerate(ends.tolist())]


def jpeg_head(height: int, width: int = WIDTH) -> bytes:
    """Everything of a frame before its entropy-coded data."""
    table = bytes([0]) + bytes(CODES_PER_LENGTH) + bytes(SYMBOLS)
    return (
        b"\xff\xd8"
        + b"\xff\xc4"
        + struct.pack(">H", len(table) + 2)
        + table
        + b"\xff\xc3"
        + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
        + b"\xff\xdd"
        + struct.pack(">HH", 4, width)
        + b"\xff\xda"
        + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    )


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes], height: int, payload: int, width: int = WIDTH) -> bytes:
    """An AVI of frames; ``payload`` is the count of bytes that the frames hold."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + chunk(b"strd", struct.pack("<Q", payload))
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl)
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        movi.append(chunk(b"00dc", frame))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        at += len(movi[-1])
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def chunks(data: bytes, at: int, end: int):
    """(name, start, size) of the chunks between two places."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


@dataclass
class Video:
    """Index of an AVI: its frames' places, the payload's length (-1 if not given), and frames a second."""

    frames: list[tuple[int, int]]
    payload: int
    fps: float


def parse_avi(data: bytes) -> Video:
    """The frames that ``idx1`` lists, or without one those that ``movi`` holds. The rate is the video stream's, or
    without one the file's. ValueError if it isn't a whole AVI with frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    frames, listed, payload, rates, movi, kind = [], [], -1, {}, 0, b""
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        at, end = stack.pop()
        inner = []
        for name, start, size in chunks(data, at, end):
            if start + size > len(data):
                raise ValueError("cut off")
            if name == b"LIST":
                movi = start if data[start : start + 4] == b"movi" else movi
                inner.append((start + 4, start + size))
            elif name == b"avih" and size >= 4:
                rates["file"] = 1e6 / max(1, struct.unpack_from("<I", data, start)[0])
            elif name == b"strh" and size >= 28:
                kind = data[start : start + 4]
                scale, rate = struct.unpack_from("<II", data, start + 20)
                if kind == b"vids" and scale and rate:
                    rates["stream"] = rate / scale
            elif name == b"strd" and size == 8:
                payload = struct.unpack_from("<Q", data, start)[0]
            elif name == b"idx1":
                listed = [struct.unpack_from("<4sIII", data, start + k) for k in range(0, size - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                frames.append((start, size))
        stack += reversed(inner)
    if listed:
        rows = [(at, size) for name, _, at, size in listed if name[2:] in (b"dc", b"db")]
        # places count from the list's name or from the file's start, as the first frame shows
        base = 0 if rows and data[rows[0][0] + 2 : rows[0][0] + 4] in (b"dc", b"db") and rows[0][0] >= movi else movi
        frames = [(base + at + 8, size) for at, size in rows]
    if not frames:
        raise ValueError("no frames")
    if any(start + size > len(data) for start, size in frames):
        raise ValueError("frames behind the end")
    return Video(frames, payload, rates.get("stream", rates.get("file", float(FPS))))


@dataclass
class Frame:
    height: int
    width: int
    per_length: tuple[int, ...]
    symbols: tuple[int, ...]
    segments: list[bytes]


def parse_frame(data: bytes) -> Frame | None:
    """Marker segments of one lossless frame of one component, rows apart, and its restart intervals without
    stuffing; None for any other process."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, height, width, table, restart = 2, 0, 0, ((), ()), 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC4:
            table = (tuple(body[1:17]), tuple(body[17:]))
        elif marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit lossless frames of one component")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return None
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            break
        at += 2 + size
    end = data.rfind(b"\xff\xd9")
    if end < at + 2 + size:
        raise ValueError("no end of image")
    segments = [s.replace(b"\xff\x00", b"\xff") for s in _RESTART.split(data[at + 2 + size : end])]
    if not height or restart != width or len(segments) != height:
        raise ValueError("rows aren't restart intervals")
    return Frame(height, width, *table, segments)


def decode_rows(segments: list[bytes], per_length: tuple[int, ...], symbols: tuple[int, ...], width: int) -> np.ndarray:
    """Samples of each segment, one row each, all decoded in lockstep."""
    sizes, lengths = np.zeros(1 << 16, np.uint8), np.ones(1 << 16, np.uint8)
    for symbol, code, length in jpeg.canonical(per_length, symbols):
        first = code << 16 - length
        sizes[first : first + (1 << 16 - length)] = symbol
        lengths[first : first + (1 << 16 - length)] = length
    stride = max(map(len, segments)) + 4
    flat = np.frombuffer(b"".join(s.ljust(stride, b"\0") for s in segments), np.uint8)
    place = np.arange(len(segments), dtype=np.int64) * (stride * 8)
    last = len(flat) - 3
    steps = np.empty((len(segments), width), np.int32)

    def peek() -> np.ndarray:
        at = np.minimum(place >> 3, last)
        word = flat[at].astype(np.int64) << 16 | flat[at + 1].astype(np.int64) << 8 | flat[at + 2]
        return word >> (8 - (place & 7)) & 0xFFFF

    for k in range(width):
        word = peek()
        size = sizes[word].astype(np.int64)
        place += lengths[word]
        extra = peek() >> (16 - size)
        place += size
        steps[:, k] = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
    return (np.cumsum(steps, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes long, as an AVI."""
    counts = [len(p) // WIDTH for p in payloads]
    heights = [min(ROWS, n) for n in counts]
    padded = [-(-n // h) * h for n, h in zip(counts, heights, strict=True)]
    joined = b"".join(p.ljust(n * WIDTH, b"\0") for p, n in zip(payloads, padded, strict=True))
    coded = code_rows(np.frombuffer(joined, np.uint8).reshape(-1, WIDTH))
    out, at = [], 0
    for payload, rows, height in zip(payloads, padded, heights, strict=True):
        head, frames = jpeg_head(height), []
        for _ in range(rows // height):
            parts = [head, coded[at]]
            for k in range(1, height):
                parts += [RESTARTS[k - 1 & 7], coded[at + k]]
            parts.append(b"\xff\xd9")
            frames.append(b"".join(parts))
            at += height
        out.append(avi(frames, height, len(payload)))
    return out


@dataclass
class Loaded:
    """A file's frames as samples, its payload's length (-1 if not given) and its rate; or what is wrong with it."""

    images: list[np.ndarray]
    payload: int = -1
    fps: float = float(FPS)
    error: str | None = None


def load(media: list[bytes | None]) -> list[Loaded]:
    """Each file decoded; frames' rows of all files go in lockstep."""
    found: list[Loaded] = []
    parsed: list[list[Frame | bytes]] = []
    kinds: dict[tuple, list[bytes]] = {}
    for data in media:
        own: list[Frame | bytes] = []
        try:
            if data is None:
                raise ValueError("no media")
            video = parse_avi(data)
            for at, size in video.frames:
                frame = parse_frame(data[at : at + size])
                own.append(data[at : at + size] if frame is None else frame)
            found.append(Loaded([], video.payload, video.fps))
        except (ValueError, IndexError, struct.error) as problem:
            own = []
            found.append(Loaded([], error=str(problem)))
        parsed.append(own)
        for f in own:
            if isinstance(f, Frame):
                kinds.setdefault((f.per_length, f.symbols, f.width), []).extend(f.segments)
    rows = {kind: decode_rows(segments, *kind) for kind, segments in kinds.items()}
    at = dict.fromkeys(rows, 0)
    for own, out in zip(parsed, found, strict=True):
        for f in own:
            if isinstance(f, Frame):
                kind = (f.per_length, f.symbols, f.width)
                out.images.append(rows[kind][at[kind] : at[kind] + f.height])
                at[kind] += f.height
            elif out.error is None:
                try:
                    out.images.append(jpeg.luma(f))
                except (ValueError, IndexError, KeyError, struct.error) as problem:
                    out.error = str(problem)
        if out.error is not None:
            out.images = []
    return found


def content_samples(video: Loaded) -> int:
    """How many samples from the start count: those of the payload without zeros at its end, 1 at least; all if
    no payload is given."""
    total = sum(map(np.size, video.images))
    if video.payload < 0:
        return total
    left, size = min(video.payload, total), 0
    last = -1
    for k, image in enumerate(video.images):
        held = np.flatnonzero(image.ravel()[: max(0, left - size)])
        last = size + int(held[-1]) if len(held) else last
        size += image.size
    return max(1, last + 1)


def histograms(images: list[np.ndarray], samples: int) -> np.ndarray:
    """Counts by frame and bin of the first ``samples`` samples."""
    flat = np.concatenate([image.ravel() for image in images])[:samples]
    which = np.repeat(np.arange(len(images)), [image.size for image in images])[:samples]
    bins = which * BINS + (flat.astype(np.int64) * BINS >> 8)
    return np.bincount(bins, minlength=len(images) * BINS).reshape(-1, BINS)


def shots(images: list[np.ndarray] | np.ndarray, samples: int = -1, span: int = 8, spread: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, end frame) of each clip.

    The difference of two histograms, 0 to 1, counts less what two samples of their sizes from the frames'
    common distribution differ by on average. A cut lies where that is over ``least`` and over the mean
    plus ``spread`` deviations of the up to ``span`` differences since the last cut. Only the first
    ``samples`` samples count, or all.
    """
    images = list(images)
    counts = histograms(images, sum(map(np.size, images)) if samples < 0 else samples).astype(np.float64)
    sizes = counts.sum(axis=1)
    a, b, n, m = counts[:-1], counts[1:], sizes[:-1, None], sizes[1:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (a + b) / (n + m)
        chance = np.sqrt(2 / np.pi * common * (1 - common) * (1 / n + 1 / m)).sum(axis=1) / 2
        steps = np.abs(a / n - b / m).sum(axis=1) / 2 - chance
    steps = np.where(np.isfinite(steps), np.maximum(0.0, steps), 0.0)  # a frame that doesn't count differs from none
    cuts, recent = [0], []
    for k, step in enumerate(steps.tolist(), 1):
        known = len(recent) >= 2
        mean = sum(recent) / len(recent) if known else 0.0
        deviation = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if known else 0.0
        if known and step > least and step > mean + spread * deviation:
            cuts.append(k)
            recent = []
        else:
            recent = [*recent[1 - span :], step]
    return list(zip(cuts, [*cuts[1:], len(images)], strict=True))


def timed(video: Loaded) -> list[tuple[int, int, float, float]]:
    """(first frame, end frame, start and end in seconds) of each clip."""
    return [(a, b, round(a / video.fps, 6), round(b / video.fps, 6)) for a, b in shots(video.images, content_samples(video))]


def padded_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def as_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with media, the text's bytes as an AVI, and n_bytes."""

    def compute(values: list[str | None]) -> list[list]:
        pairs = [padded_payload(v) for v in values]
        return [store([p for p, _ in pairs]), [n for _, n in pairs]]

    return add_columns(docs, text, [("media", T.BinaryType()), ("n_bytes", T.LongType())], compute)


CLIPS = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField(
            "clips",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("first_frame", T.LongType()),
                        T.StructField("end_frame", T.LongType()),
                        T.StructField("start_s", T.DoubleType()),
                        T.StructField("end_s", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
CLIP_COLUMNS = ("clip", "first_frame", "end_frame", "start_s", "end_s", "error")


def clips(table: DataFrame, media: str = "media") -> DataFrame:
    """A row for each clip of each AVI in ``media``: ``table`` without it, clip from 0, its frames and times, error.

    Columns of ``table`` named as a result column give way to it.
    """

    def compute(values: list[bytes | None]) -> list[list]:
        found = load(values)
        return [[{"error": v.error, "clips": [] if v.error else [dict(zip(CLIP_COLUMNS[1:5], c, strict=True)) for c in timed(v)]} for v in found]]

    kept = [f"`{c}`" for c in table.columns if c not in CLIP_COLUMNS]
    own, one = unused(table.columns, "__found"), unused(table.columns, "__clip")
    found = add_columns(table.select(*kept), media, [(own, CLIPS)], compute, drop=True)
    rest = [f"`{c}`" for c in found.columns if c != own]
    rows = found.select(*rest, F.posexplode_outer(f"{own}.clips").alias("clip", one), F.col(f"{own}.error").alias("error"))
    return rows.select(*rest, "clip", *[F.col(f"{one}.{c}").alias(c) for c in CLIP_COLUMNS[1:5]], "error")


DIGEST = [
    ("n_bytes", T.LongType()),
    ("payload_bytes", T.LongType()),
    ("payload_sha256", T.StringType()),
    ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()),
    ("media_sha256", T.StringType()),
    ("feature", T.StringType()),
]


def stored_and_read(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with digests of the media and of the payload read back from it;
    feature lists the clips, each as first-end@start, frames and seconds."""

    def compute(values: list[str | None]) -> list[list]:
        pairs = [padded_payload(v) for v in values]
        media, out = store([p for p, _ in pairs]), []
        for stored, (_, n_bytes), video in zip(media, pairs, load(media), strict=True):
            if video.error:
                raise ValueError(video.error)
            size = video.payload
            back = b"".join(image.tobytes() for image in video.images)[:size]
            out.append(
                [
                    n_bytes,
                    size,
                    hashlib.sha256(back).hexdigest(),
                    zlib.crc32(back[-64:]),
                    len(stored),
                    hashlib.sha256(stored).hexdigest(),
                    ",".join(f"{a}-{b}@{start:.2f}" for a, b, start, _ in timed(video)),
                ]
            )
        return list(map(list, zip(*out, strict=True))) if out else [[]] * len(DIGEST)

    return add_columns(docs, text, DIGEST, compute, drop=True)
