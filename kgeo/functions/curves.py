"""Bit-level functions that columns cannot express: Arrow functions over whole batches with numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgeo.functions.geometry import PHI, PSI
from kgeo.schema import POINT

COMPOSITION, ATOM, RELATION = 0, 1, 2


def hilbert_words(cells: np.ndarray, bits: int = 32) -> np.ndarray:
    """Skilling's transform: rows of ``n`` coordinates of ``bits`` bits to rows of the transposed Hilbert index."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] ^= t
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    return (x ^ t).T


def hilbert_keys(unit: np.ndarray, kind: int = COMPOSITION, bits: int = 32) -> list[bytes]:
    """128-bit keys, most significant byte first, of points in the unit 4-cube; the two lowest bits are the kind."""
    cells = (np.clip(unit, 0.0, 1.0) * float((1 << bits) - 1)).astype(np.uint64)
    words = hilbert_words(cells, bits)
    planes = ((words[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)[None, :, None]) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(planes.reshape(len(unit), bits * unit.shape[1]), axis=1)
    packed[:, -1] = (packed[:, -1] & 0xFC) | kind
    return [x.tobytes() for x in packed]


def hilbert(kind: int = COMPOSITION):
    """Column function of x, y, z, w in [0, 1] (others are clamped) to a 16-byte key; null for a null coordinate."""

    @F.pandas_udf(T.BinaryType())
    def key(x: pd.Series, y: pd.Series, z: pd.Series, w: pd.Series) -> pd.Series:
        m = np.column_stack([x, y, z, w]).astype(float)
        ok = ~np.isnan(m).any(1)
        out = np.full(len(m), None, object)
        out[ok] = hilbert_keys(m[ok], kind)
        return pd.Series(out)

    return key


@F.pandas_udf(T.BinaryType())
def curve_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """|a - b| of 128-bit keys."""
    return pd.Series([None if x is None or y is None else abs(int.from_bytes(x, "big") - int.from_bytes(y, "big")).to_bytes(16, "big") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(POINT)
def hash_point(h: pd.Series) -> pd.DataFrame:
    """A 16-byte hash to a point: both halves mixed to one 64-bit number, whose share of the range gives all three angles."""
    two = np.frombuffer(b"".join((x or b"").ljust(16, b"\0")[:16] for x in h), "<u8").reshape(-1, 2)
    p, q = two[:, 0], two[:, 1]
    seed = p ^ (q + np.uint64(0x9E3779B9) + (p << np.uint64(6)) + (p >> np.uint64(2)))
    t = seed.astype(float) / float((1 << 64) - 1)
    y = 1 - 2 * t
    r, turn, fibre = np.sqrt(np.maximum(0, 1 - y * y)), np.mod(t * PHI, 1.0) * 2 * np.pi, np.mod(t * PSI, 1.0) * 2 * np.pi
    sx, sz = r * np.cos(turn), r * np.sin(turn)
    r1, r2, phase = np.sqrt(np.maximum(0, (1 + sx) / 2)), np.sqrt(np.maximum(0, (1 - sx) / 2)), fibre - np.arctan2(sz, y)
    return pd.DataFrame({"x": r1 * np.cos(fibre), "y": r1 * np.sin(fibre), "z": r2 * np.cos(phase), "w": r2 * np.sin(phase)})
