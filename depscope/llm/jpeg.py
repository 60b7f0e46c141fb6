"""Baseline JPEG frames, as other programs write them into motion-JPEG: the luma samples of one frame.

Sequential Huffman-coded frames of 8 bits, one interleaved scan, with or without restart intervals; tables that a
frame leaves out are the standard's usual ones, as is common in AVI. Anything else raises ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


def canonical(per_length: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as JPEG defines it."""
    out, code, at = [], 0, 0
    for length, count in enumerate(per_length, 1):
        for _ in range(count):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def whole(first: str) -> tuple[int, ...]:
    """Run and size symbols: the usual ones in the order given, then all others upward."""
    told = tuple(bytes.fromhex(first))
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return (*told, *sorted(set(every) - set(told)))


#: Fixed values of the JPEG standard: codes per length and first symbols of the usual tables, by class (0 DC, 1 AC) and luma or chroma.
USUAL = {
    (0, 0): ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    (0, 1): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
    (1, 0): (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        whole("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    ),
    (1, 1): (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        whole("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
    ),
}


def zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in the order in which they are coded."""
    cells = [(x + y, y if (x + y) % 2 else x, 8 * y + x) for y in range(8) for x in range(8)]
    return np.array([place for *_, place in sorted(cells)])


ZIGZAG = zigzag()
#: Rows are the cosine waves of a block's line.
WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5**1.5) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def lookup(per_length: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, length) by the next 16 bits; length 0 where there is no code."""
    out = [(0, 0)] * (1 << 16)
    for symbol, code, length in canonical(per_length, symbols):
        first = code << 16 - length
        out[first : first + (1 << 16 - length)] = [(symbol, length)] * (1 << 16 - length)
    return out


class Bits:
    """An entropy-coded segment, read bit by bit from the front; behind its end come ones."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.count = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            if self.at > len(self.data) + 8:
                raise ValueError("coded data ends early")
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.count += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.count -= n
        out = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        symbol, length = table[self.held >> self.count - 16]
        if not length:
            raise ValueError("no such code")
        self.take(length)
        return symbol

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> size - 1 else value - (1 << size) + 1


def block(bits: Bits, dc: list, ac: list, before: int) -> tuple[int, list[int]]:
    """The DC value and the 64 coefficients in coded order."""
    out = [0] * 64
    out[0] = before + bits.signed(bits.symbol(dc))
    k = 1
    while k < 64:
        symbol = bits.symbol(ac)
        run, size = symbol >> 4, symbol & 15
        if not size and run != 15:
            break
        k += run
        if k > 63:
            raise ValueError("too many coefficients")
        out[k] = bits.signed(size)
        k += 1
    return out[0], out


def luma(data: bytes) -> np.ndarray:
    """The first component's samples, height by width."""
    tables = {(kind, which): value for (kind, which), value in USUAL.items()}
    quant: dict[int, np.ndarray] = {}
    at, parts, restart, height, width = 2, [], 0, 0, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                raw = body[1 : 65 + 64 * wide]
                quant[which] = np.frombuffer(raw, ">u2" if wide else np.uint8, 64).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + count]))
                body = body[17 + count :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width:
                raise ValueError("only frames of 8 bits with a size")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            break
    chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if not parts or set(chosen) != {p[0] for p in parts} or any(not p[1] or not p[2] for p in parts):
        raise ValueError("not one scan of all components")
    end = data.rfind(b"\xff\xd9")
    coded = data[at : end if end >= at else len(data)]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a component alone isn't interleaved
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        across = down = 1
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    codes = [(lookup(*tables[0, chosen[p[0]] >> 4]), lookup(*tables[1, chosen[p[0]] & 15])) for p in parts]
    h, v = parts[0][1], parts[0][2]
    found = np.zeros((rows * v, columns * h, 64))
    segments = split_restarts(coded) if restart else [coded]
    total = rows * columns
    for number, segment in enumerate(segments):
        bits, before = Bits(segment), [0] * len(parts)
        first = number * restart
        for unit in range(first, min(total, first + (restart or total))):
            y, x = divmod(unit, columns)
            for c, (_, wide, high, _) in enumerate(parts):
                for k in range(wide * high):
                    before[c], values = block(bits, *codes[c], before[c])
                    if not c:
                        found[y * v + k // wide, x * h + k % wide] = values
    if restart and len(segments) * restart < total:
        raise ValueError("coded data ends early")
    if parts[0][3] not in quant:
        raise ValueError("no quantisation table")
    plain = np.zeros_like(found)
    plain[..., ZIGZAG] = found * quant[parts[0][3]]
    blocks = WAVES.T @ plain.reshape(rows * v, columns * h, 8, 8) @ WAVES
    image = blocks.transpose(0, 2, 1, 3).reshape(rows * v * 8, columns * h * 8)
    scaled = (-(-height * v // down), -(-width * h // across))
    return np.clip(np.rint(image + 128), 0, 255).astype(np.uint8)[: scaled[0], : scaled[1]]


def split_restarts(coded: bytes) -> list[bytes]:
    """The segments between restart markers."""
    out, start, at = [], 0, coded.find(b"\xff")
    while at >= 0:
        if at + 1 < len(coded) and 0xD0 <= coded[at + 1] <= 0xD7:
            out.append(coded[start:at])
            start = at + 2
        at = coded.find(b"\xff", at + 2)
    return [*out, coded[start:]]
