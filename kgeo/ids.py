"""Content ids: the layouts of what is hashed, and the two hashes for it (md5 in the engine, BLAKE3 in Arrow batches)."""

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

COMPOSITION, RELATION, PHYSICALITY, SEQUENCE, MEMBER, MODEL = b"\x43", b"\x52", b"\x50", b"\x53", b"\x54", b"\x4d"

#: Fixed values of the public BLAKE3 specification: the initial chaining value and the permutation of message words.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF


def _compress(cv: tuple, words: list[int], counter: int, size: int, flags: int) -> list[int]:
    v = [*cv, *IV[:4], counter & _M, counter >> 32, size, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for m, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + m) & _M
            t = v[d] ^ v[a]
            v[d] = (t >> r1 | t << (32 - r1)) & _M
            v[c] = (v[c] + v[d]) & _M
            t = v[b] ^ v[c]
            v[b] = (t >> r2 | t << (32 - r2)) & _M

    for k in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, words[2 * i], words[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, words[8 + 2 * i], words[9 + 2 * i])
        if k < 6:
            words = [words[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ cv[i] for i in range(8)]


def _words(block: bytes) -> list[int]:
    return [*struct.unpack("<16I", block.ljust(64, b"\0"))]


def blake3(data: bytes, size: int = 32) -> bytes:
    """The BLAKE3 hash, to 64 bytes."""

    def node(part: bytes, first: int) -> tuple:
        """(chaining value, words, counter, length, flags) of the last compression of a subtree."""
        if len(part) <= 1024:
            cv, blocks = IV, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for i, b in enumerate(blocks[:-1]):
                cv = tuple(_compress(cv, _words(b), first, 64, CHUNK_START * (i == 0))[:8])
            return cv, _words(blocks[-1]), first, len(blocks[-1]), CHUNK_START * (len(blocks) == 1) | CHUNK_END
        left = 1024 << ((len(part) - 1) // 1024).bit_length() - 1
        both = [x for half, at in ((part[:left], first), (part[left:], first + left // 1024)) for x in _compress(*node(half, at))[:8]]
        return IV, both, 0, 64, PARENT

    cv, words, counter, n, flags = node(data, 0)
    return struct.pack("<16I", *_compress(cv, words, 0 if flags & PARENT else counter, n, flags | ROOT))[:size]


@F.pandas_udf(StringType())
def blake3_hex(data: pd.Series) -> pd.Series:
    """First 16 bytes of the BLAKE3 hash of a binary column, as hex."""
    return pd.Series([None if x is None else blake3(bytes(x), 16).hex() for x in data])


def preimage(tag: bytes, *parts: Column) -> Column:
    """``tag`` and 16-byte ids given as hex."""
    return F.concat(F.lit(bytearray(tag)), *[F.unhex(p) for p in parts])


def content_id(data: Column, backend: str = "md5") -> Column:
    """Hex id of a binary or string column."""
    return F.md5(data) if backend == "md5" else blake3_hex(data.cast("binary"))


def relation_id(a: Column, b: Column, backend: str = "md5") -> Column:
    """The same for (a, b) and (b, a)."""
    return content_id(preimage(RELATION, F.least(a, b), F.greatest(a, b)), backend)


def u32(x: Column) -> Column:
    """Four bytes, least significant first."""
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def atom_id(cp: Column, backend: str = "md5") -> Column:
    return content_id(u32(cp), backend)


def clean_hex(text: Column) -> Column:
    """An id without hyphens, in lower case; null unless 32 digits remain."""
    h = F.lower(F.regexp_replace(text, "-", ""))
    return F.when(h.rlike("^[0-9a-f]{32}$"), h)


def with_hyphens(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
