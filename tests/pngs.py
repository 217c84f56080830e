"""Tiny PNG writer (zlib + struct) for image-source tests."""

from __future__ import annotations

import struct
import zlib


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)


def write_png(path: str, rows, grey: bool = False) -> None:
    """``rows``: list of rows; each row a list of (r, g, b) tuples, or of
    ints when ``grey``."""
    h, w = len(rows), len(rows[0])
    raw = bytearray()
    for row in rows:
        raw.append(0)
        for px in row:
            if grey:
                raw.append(px)
            else:
                raw.extend(bytes(px))
    ihdr = struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)
    data = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(bytes(raw))) + \
        _chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(data)


def two_half_image(h: int = 40, w: int = 40):
    """Left half forest green, right half reddish (RGB order); noise-free
    version of the two-half test image."""
    left = (34, 139, 34)     # RGB of BGR (34, 139, 34)
    right = (165, 42, 42)    # RGB of BGR (42, 42, 165)
    return [[left if x < w // 2 else right for x in range(w)] for _ in range(h)]


def write_tiff(path: str, rows) -> None:
    """Baseline TIFF: little-endian, uncompressed 8-bit RGB, one strip.
    ``rows``: list of rows of (r, g, b) tuples."""
    h, w = len(rows), len(rows[0])
    pixels = bytes(c for row in rows for px in row for c in px)
    entries = [  # (tag, type, count, value); type 3 = SHORT, 4 = LONG
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, None), (259, 3, 1, 1), (262, 3, 1, 2),
        (273, 4, 1, None), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(pixels)), (284, 3, 1, 1),
    ]
    ifd_size = 2 + 12 * len(entries) + 4
    bits_offset = 8 + ifd_size
    data_offset = bits_offset + 6
    out = bytearray(b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries)))
    for tag, typ, count, value in entries:
        if tag == 258:
            value = bits_offset
        elif tag == 273:
            value = data_offset
        packed = struct.pack("<HI", value, 0)[:4] if (typ == 3 and count == 1) else struct.pack("<I", value)
        out += struct.pack("<HHI", tag, typ, count) + packed
    out += struct.pack("<I", 0) + struct.pack("<HHH", 8, 8, 8) + pixels
    with open(path, "wb") as f:
        f.write(bytes(out))
