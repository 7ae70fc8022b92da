"""Token ids of whole texts, each distinct stretch of text encoded once per worker.

A text is cut where no pre-token of the tokenizer can lie on both sides, so the ids of the stretches, joined, are
the ids of the text. A stretch is a run of white space with the run of other characters after it. Equal stretches are found
by their bytes (an Arrow dictionary), never by a hash alone. The tokenizers library encodes every stretch itself; only repeats
come from memory. For a tokenizer that drops white space and lower-cases, A-Z are lowered first and ASCII white space is
one kind of space, so that more stretches are equal."""

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Unicode white space: the ASCII bytes, and the UTF-8 forms of the rest by their first byte.
GAPS = np.zeros(256, bool)
GAPS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
WIDE = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), 0xE3: (b"\x80\x80",)}
#: ASCII marks that are cut off the end of a stretch where a letter stands before them. No apostrophe: it may begin a contraction.
MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_MARK_BYTES, _GAP_BYTES = frozenset(MARKS), frozenset(np.flatnonzero(GAPS).tolist())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.where(GAPS, np.uint8(32), LOWER)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where its rows begin and end in them; nulls are empty."""
    column = column.cast(pa.binary()).fill_null(b"") if column.null_count or not pa.types.is_binary(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def byte_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows between ``ends`` (its first is 0), without a copy of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def row_ranges(ends: np.ndarray, size: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, so that a batch of long texts is worked off piecemeal."""
    lo = 0
    while lo < len(ends) - 1:
        hi = min(len(ends) - 1, max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1))
        yield lo, hi
        lo = hi


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text's beginning, and where white space follows something else."""
    gap = GAPS[data]
    for lead, tails in WIDE.items():
        at = np.flatnonzero(data == lead)
        for tail in tails if len(at) else ():
            inside = at[at + len(tail) < len(data)]
            hit = inside[np.logical_and.reduce([data[inside + 1 + i] == x for i, x in enumerate(tail)])]
            for i in range(len(tail) + 1):
                gap[hit + i] = True
    begins = gap.copy()
    begins[1:] &= ~gap[:-1]
    begins[ends[:-1][ends[:-1] < ends[1:]]] = True
    return np.flatnonzero(begins)


class Recent:
    """A memory of two generations, bounded in bytes: when the young one is full, the old one is forgotten; what is asked for
    again stays."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.weight = limit, {}, {}, 0

    def age(self) -> None:
        if self.weight > self.limit:
            self.young, self.old, self.weight = {}, self.young, 0

    def put(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.weight += sum(map(len, keys)) + sum(map(len, values)) + 180 * len(keys)

    def absent(self, keys: list) -> list:
        """The keys (each once) that are unknown; all others are in ``young`` afterwards."""
        young, old = self.young, self.old
        left = [k for k in keys if k not in young]
        if old and left:
            again = [k for k in left if k in old]
            self.put(again, [old[k] for k in again])
            left = [k for k in left if k not in old]
        return left


class Stretches:
    """``ids`` gives the token ids of whole texts. Subclasses know how to ``learn`` stretches: bytes in, their ids as bytes of
    ``dtype`` out. The memory of stretches is bounded by ``limit`` bytes, twice."""

    def __init__(self, dtype: np.dtype, plain: bool, limit: int):
        self.dtype, self.plain, self.known = np.dtype(dtype), plain, Recent(limit)

    def learn(self, missing: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def values(self, keys: list[bytes]) -> list[bytes]:
        self.known.age()
        if missing := self.known.absent(keys):
            self.known.put(missing, self.learn(missing))
        return [*map(self.known.young.__getitem__, keys)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's begin and end. Nulls and empty texts have none."""
        data, ends = utf8(texts)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(ends), np.int64)
        data = PLAIN[data] if self.plain else data
        begins = cuts(data, ends)
        kinds = byte_column(data, np.append(begins, len(data))).dictionary_encode()
        each, at = utf8(kinds.dictionary)
        raw, at = each.tobytes(), at.tolist()
        values = self.values([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        sizes = np.array([*map(len, values)], np.int64) // self.dtype.itemsize
        pool, at, of = np.frombuffer(b"".join(values), self.dtype), np.cumsum(sizes) - sizes, kinds.indices.to_numpy()
        n = sizes[of]
        last = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(at[of] - last[:-1], n) + np.arange(last[-1])]
        return ids, last[np.searchsorted(begins, ends)]


class StretchEncoder(Stretches):
    """Ids as the tokenizers library gives them, with add_special_tokens=False. A special token's string in a text gets that
    token's id, as the library does by default; with ``special`` False it is ordinary text."""

    def __init__(self, path: str, keeps_space: bool, limit: int = 96 << 20, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the strings of special tokens are cut out before the library sees a text
        super().__init__("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4", not keeps_space, limit)
        marks = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()} if special else {}
        self.marks = {m.encode(): i for m, i in marks.items()}
        self.at_marks = re.compile(b"|".join(map(re.escape, sorted(self.marks, key=len, reverse=True)))) if marks else None
        # Stretches are handed over joined by a character with a single id of its own that no other stretch's ids hold.
        self.between, self.own = ("\n", "\n") if keeps_space else (" \x01 ", "\x01")
        found = self.library.encode(self.own, add_special_tokens=False).ids
        self.cut = found[0] if len(found) == 1 else None

    def _library(self, stretches: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(stretches), 4096):
            found = self.library.encode_batch_fast(stretches[lo : lo + 4096], add_special_tokens=False)
            out += [np.array(e.ids, self.dtype).tobytes() for e in found]
        return out

    def _joined(self, stretches: list[str]) -> list[bytes]:
        out, size = [], self.dtype.itemsize
        for lo in range(0, len(stretches), 1024):
            part = stretches[lo : lo + 1024]
            ids = np.array(self.library.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            raw, at = ids.tobytes(), (np.flatnonzero(ids == self.cut) * size).tolist()
            pieces = [raw[a:b] for a, b in zip([0, *(x + size for x in at)], [*at, len(raw)], strict=True)]
            out += pieces if len(pieces) == len(part) else self._library(part)
        return out

    def _whole(self, stretches: list[bytes]) -> list[bytes]:
        texts = [x.decode() for x in stretches]
        if self.cut is None:
            return self._library(texts)
        easy = [i for i, x in enumerate(texts) if len(x) < 4096 and self.own not in x]
        hard = sorted({*range(len(texts))}.difference(easy))
        out: list = [None] * len(texts)
        for places, way in ((easy, self._joined), (hard, self._library)):
            for i, x in zip(places, way([texts[i] for i in places]), strict=True):
                out[i] = x
        return out

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """Stretches that end with marks after a letter, or begin with a line end alone, are put together from their parts."""
        made: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        for x in missing:
            head, y, tail = b"", x, b""
            if x[0] == 10 and len(x) > 1 and x[1] < 128 and x[1] not in _GAP_BYTES:
                head, y = b"\n", x[1:]
            if x[-1] in _MARK_BYTES:
                z = y.rstrip(MARKS)
                if z[-1:].isalpha() or z[-2:-1] in (b"\xc4", b"\xc5") or (z[-2:-1] == b"\xc3" and z[-1] not in b"\x97\xb7"):
                    y, tail = z, y[len(z) :]
            if y is not x:
                made[x] = (head, y, tail)
        parts = self.known.absent([*{p for x in made.values() for p in x if p}])
        fresh = {*parts, *(x for x in missing if x not in made)}
        whole = [*fresh]
        found = dict(zip(whole, self._whole(whole), strict=True))
        self.known.put(parts, [found[p] for p in parts])
        young = self.known.young
        young[b""] = b""
        return [found[x] if x in found else b"".join([young[p] for p in made[x]]) for x in missing]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = utf8(texts)
        if not self.at_marks or not self.at_marks.search(data):
            return super().ids(texts)
        # The library cuts a text at the strings of special tokens and encodes what lies between them alone.
        parts, special, of, raw = [], [], [], data.tobytes()
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            for m in (*self.at_marks.finditer(raw, a, b), None):
                parts.append(raw[a : m.start() if m else b])
                special.append(self.marks[m.group()] if m else -1)
                of.append(i)
                a = m.end() if m else b
        ids, last = super().ids(pa.array(parts, pa.binary()))
        special, of = np.array(special), np.array(of)
        out = np.insert(ids, last[1:][special >= 0], special[special >= 0].astype(self.dtype))
        sizes = np.bincount(of, np.diff(last) + (special >= 0), len(texts)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(sizes)])


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids."""
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def slices(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each, so that a batch of long texts is cut up piecemeal."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict[tuple, StretchEncoder] = {}


def encoder(path: str, keeps_space: bool) -> StretchEncoder:
    """One encoder per worker process and file."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = StretchEncoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]
