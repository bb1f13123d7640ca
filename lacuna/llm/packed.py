"""Arrays and words of a block of texts as one compressed value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> bytes:
    """Integers by byte place (all lowest bytes first), so that small numbers leave long runs of zeros."""
    raw = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def packed_words(words: list[bytes]) -> bytes:
    """Words that hold no line break."""
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return raw.split(b"\n") if raw else []
