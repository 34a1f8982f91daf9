"""Baseline JPEG in numpy: 8x8 cosine transforms, quantisation, Huffman codes; colours are not subsampled."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: quantisation at quality 50 (luminance, chrominance), and code counts and symbols of the usual tables.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
CHROMA = np.full((8, 8), 99)
CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))


def _zigzag() -> np.ndarray:
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([y * 8 + x for y, x in order])


ZIGZAG = _zigzag()


def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


COSINES = _cosines()


def _ac_table() -> tuple[bytes, bytes]:
    """A complete code for all (zero run, size) symbols, shorter for short runs and sizes; the file carries it, so any will do."""
    symbols = sorted((run << 4 | size for run in range(16) for size in range(1, 11)), key=lambda s: ((s >> 4) + 2 * (s & 15), s))
    symbols = [0x00, symbols[0], symbols[1], 0xF0, *symbols[2:]]
    counts = [0, 1, 1, 1, 2, 2, 4, 6, 8, 10, 14, 18]
    left = len(symbols) - sum(counts)
    counts += [0, 0, 0, left]
    return bytes(counts), bytes(symbols)


AC_COUNTS, AC_SYMBOLS = _ac_table()


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    code, at, made = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            made[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return made


DC, AC = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)


def quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip((t * scale + 50) // 100, 1, 255).astype(int) for t in (LUMA, CHROMA)]


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    b = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8) - 128
    return np.rint(COSINES @ b @ COSINES.T / table).astype(int).reshape(-1, 64)[:, ZIGZAG]


def _segment(kind: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data


def encode(rgb: np.ndarray, quality: int = 90) -> bytes:
    """JPEG bytes of a picture (height x width x RGB)."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be between 1 and 100")
    height, width = rgb.shape[:2]
    full = np.pad(rgb.astype(float), ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = (full[..., i] for i in range(3))
    planes = (0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b)
    tables = quantisers(quality)
    parts = [_blocks(p, tables[min(i, 1)]) for i, p in enumerate(planes)]
    value, held, out, last = 0, 0, bytearray(), [0, 0, 0]

    def put(code: int, length: int) -> None:
        nonlocal value, held
        value, held = value << length | code, held + length
        while held >= 8:
            byte = value >> (held - 8) & 0xFF
            out.append(byte)
            if byte == 0xFF:
                out.append(0)
            held -= 8
        value &= (1 << held) - 1

    def number(v: int, size: int) -> None:
        if size:
            put(v if v > 0 else v + (1 << size) - 1, size)

    for n in range(len(parts[0])):
        for c in range(3):
            block = parts[c][n]
            step = int(block[0]) - last[c]
            last[c] = int(block[0])
            size = abs(step).bit_length()
            put(*DC[size])
            number(step, size)
            before = 0
            for at in np.flatnonzero(block[1:]) + 1:
                run = int(at) - before - 1
                while run > 15:
                    put(*AC[0xF0])
                    run -= 16
                v = int(block[at])
                size = abs(v).bit_length()
                put(*AC[run << 4 | size])
                number(v, size)
                before = int(at)
            if before < 63:
                put(*AC[0])
    if held:
        put((1 << (8 - held)) - 1, 8 - held)
    head = _segment(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0))
    head += b"".join(_segment(0xDB, bytes([i]) + bytes(t.reshape(-1)[ZIGZAG].tolist())) for i, t in enumerate(tables))
    head += _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3)))
    head += _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
    head += _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + head + bytes(out) + b"\xff\xd9"
