"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes."""

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.chunks import Recent, Stretches, row_ranges, utf8

_MASK = (1 << 64) - 1


def _slot(h: int, shift: int, n: int) -> int:
    x = (h ^ (shift * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: n keys in n slots, one displacement per bucket.

    Buckets of two or more keys get the first displacement that puts all their keys in free slots, largest bucket first;
    buckets of one key name a free slot directly (as -1 - slot)."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            held[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.key: list[bytes | None] = [None] * self.n
        self.at = [0] * self.n
        for b in sorted((b for b in range(self.buckets) if len(held[b]) > 1), key=lambda b: -len(held[b])):
            for shift in itertools.count():
                slots = {_slot(hashes[i], shift, self.n) for i in held[b]}
                if len(slots) == len(held[b]) and all(self.key[s] is None for s in slots):
                    break
            self.shift[b] = shift
            for i in held[b]:
                self._put(_slot(hashes[i], shift, self.n), keys[i], i)
        free = (s for s in range(self.n) if self.key[s] is None)
        for b in (b for b in range(self.buckets) if len(held[b]) == 1):
            s = next(free)
            self.shift[b] = -1 - s
            self._put(s, keys[held[b][0]], held[b][0])

    def _put(self, slot: int, key: bytes, index: int) -> None:
        self.key[slot], self.at[slot] = key, index

    def get(self, key: bytes) -> int:
        """The key's place in the list it was built from; -1 for other strings."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.buckets]
        slot = -1 - shift if shift < 0 else _slot(h, shift, self.n)
        return self.at[slot] if self.key[slot] == key else -1


class BytePairEncoder(Stretches):
    """``ranks``: token bytes to id, all 256 single bytes among them. ``pattern`` splits a text into pre-tokens.

    What is remembered of stretches and pre-tokens is bounded by ``limit`` bytes each, twice."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 64 << 20):
        import regex

        super().__init__("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4", False, limit)
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.one = [np.array([i], self.dtype).tobytes() for i in ranks.values()]
        self.whole = PerfectHash([*ranks])
        self.split = regex.compile(pattern).findall
        self.words = Recent(limit)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "BytePairEncoder":
        """``path``: lines of a token in base 64 and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, leftmost first, until no pair is a token; n log n in the word's length."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if not alive[i] or mid >= n or after[mid] != end:
                continue
            alive[mid] = 0
            after[i] = end
            if end < n:
                before[end] = i
                stop = after[end]
                if (r := rank(word[i:stop])) is not None:
                    heapq.heappush(heap, (r, i, stop))
            if (left := before[i]) >= 0 and (r := rank(word[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def word(self, data: bytes) -> bytes:
        at = self.whole.get(data)
        return self.one[at] if at >= 0 else np.array(self.merge(data), self.dtype).tobytes()

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """Each stretch's pre-tokens by the pattern; linear in their number, and n log n in a pre-token's length."""
        self.words.age()
        split = [[w.encode() for w in self.split(x.decode())] for x in missing]
        unknown = self.words.absent([*dict.fromkeys(w for x in split for w in x)])
        self.words.put(unknown, [*map(self.word, unknown)])
        known = self.words.young.__getitem__
        return [known(x[0]) if len(x) == 1 else b"".join(map(known, x)) for x in split]

    def encode(self, text: str) -> list[int]:
        return self.ids(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def worker_encoder(path: str, pattern: str) -> BytePairEncoder:
    """One per worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BytePairEncoder.from_file(path, pattern)
    return _ENCODERS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int). Null and empty texts have no ids. Equal rows and rows with null ids stay rows of
    their own; an empty table gives none. Texts of any length: one's ids are in memory at a time with those of others up to
    eight million bytes of text; time grows with the length, up to n log n within one pre-token. Only the two columns are
    read, so others may be called doc_id or ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path, pattern)
        for batch in batches:
            for lo, hi in row_ranges(utf8(batch.column(1))[1]):
                ids, ends = enc.ids(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_column(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of doc_id and ids: doc_id, data (the decoded bytes). Null ids decode to null, no ids to no bytes; an unknown id
    raises. Equal rows and null doc_ids stay; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path, pattern)
        for batch in batches:
            data = [enc.decode(x.values.to_pylist()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256, from the encoded ids
    and their decoding. Null and empty texts: no tokens, the digests of nothing. Equal rows and null ids stay rows of their
    own; an empty table gives none; other columns are ignored. One pass without a shuffle; long texts as in encode_column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path, pattern)
        decimal = {i: str(i) for i in enc.token}.__getitem__
        for batch in batches:
            for lo, hi in row_ranges(utf8(batch.column(1))[1]):
                ids, ends = enc.ids(batch.column(1).slice(lo, hi - lo))
                a, b = [], []
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    own = ids[x:y].tolist()
                    a.append(hashlib.sha256(" ".join(map(decimal, own)).encode()).hexdigest())
                    b.append(hashlib.sha256(enc.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, encoded and decoded."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
