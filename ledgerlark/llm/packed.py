"""Whole numbers packed into bytes: each byte of their width is a plane of its own, compressed alone where that helps."""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def packed(x: np.ndarray) -> bytes:
    """One array of unsigned numbers with its length, in no more bytes a number than its greatest one takes."""
    press = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=True).compress
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    raw = np.ascontiguousarray(x, "<u8" if width > 4 else "<u4").view(np.uint8).reshape(len(x), 8 if width > 4 else 4)
    out = [np.array([len(x), width], "<u4").tobytes()]
    for k in range(width):
        plane = raw[:, k].tobytes()
        small = press(plane)
        out += [np.array([min(len(small), len(plane))], "<u4").tobytes(), small if len(small) < len(plane) else plane]
    return b"".join(out)


def joined(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts)], "<u4").tobytes(), *parts])


def pack(arrays: list[np.ndarray]) -> bytes:
    return joined([packed(x) for x in arrays])


def unpack(data: bytes) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress
    number = lambda at: int.from_bytes(data[at : at + 4], "little")
    at, out = 4, []
    for _ in range(number(0)):
        n, width = number(at), number(at + 4)
        at += 8
        x = np.zeros((n, 8), np.uint8)
        for k in range(width):
            size = number(at)
            raw = data[at + 4 : at + 4 + size]
            x[:, k] = np.frombuffer(raw if size == n else plain(raw), np.uint8)
            at += 4 + size
        out.append(x.view("<u8").reshape(n).astype(np.uint64))
    return out
