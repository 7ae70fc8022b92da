"""Packing token sequences: first-fit decreasing on a tournament tree of bin capacities, in randomised groups."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.chunks import byte_column, encoder, row_ranges, utf8, with_end
from kgeo.llm.storage import width

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
#: Bytes of text that a worker encodes at once; its tables take some twenty times that.
RANGE = 1 << 21


class CapacityTree:
    """A complete binary tree whose leaves are the bins' free room and whose inner nodes hold the larger child."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The leftmost bin with room for ``size``, whose room is then reduced."""
        most, at = self.most, 1
        while at < self.leaves:
            at = 2 * at if most[2 * at] >= size else 2 * at + 1
        found = at - self.leaves
        most[at] -= size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def pack(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) that hold every token of every item once.

    Items longer than ``room`` give full bins and a rest; the rests are placed by first-fit decreasing (ties in order of the
    items). What is still free is closed by cutting pieces of the emptiest bins, so that one bin at most is not full; that one
    is cut into bins of power-of-two sizes, which need no padding. Items of length 0 have no piece."""
    full, rests = [], []
    for item, n in enumerate(lengths):
        whole = n - n % room
        full += [[(item, s, room)] for s in range(0, whole, room)]
        if n > whole:
            rests.append((item, whole, n - whole))
    rests.sort(key=lambda x: (-x[2], x[0]))
    tree, bins = CapacityTree(len(rests), room), [[] for _ in rests]
    for x in rests:
        bins[tree.first_fit(x[2])].append(x)
    bins = sorted((b for b in bins if b), key=lambda b: -sum(x[2] for x in b))
    lo, hi = 0, len(bins) - 1
    while lo < hi:
        free = room - sum(x[2] for x in bins[lo])
        while free and lo < hi:
            item, start, n = bins[hi].pop()
            if n <= free:
                bins[lo].append((item, start, n))
                free -= n
            else:
                bins[lo].append((item, start, free))
                bins[hi].append((item, start + free, n - free))
                free = 0
            if not bins[hi]:
                hi -= 1
        lo += not free
    last = [b for b in bins if b and sum(x[2] for x in b) < room]
    out = full + [b for b in bins if b and sum(x[2] for x in b) == room]
    for b in last:
        left = sum(x[2] for x in b)
        while left:
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                item, start, n = b.pop(0)
                part.append((item, start, min(n, size)))
                if n > size:
                    b.insert(0, (item, start + size, n - size))
                size -= min(n, size)
            out.append(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, room: int = 1024, keeps_space: bool = True, group_docs: int = 1024, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """One row per piece (PIECES): where it comes from in its document and where it lies in its sequence.

    A document is its token ids and ``end_id``; null text counts as empty. Documents are dealt to groups of about
    ``group_docs`` at random (by a hash of id and row), so no key or source makes a group large, and each group is packed
    alone. Null ids and equal rows are documents of their own. An empty table has no pieces. Extra columns are ignored.
    Sequences that a long document fills alone are cut where it is encoded, so only their numbers and what is left of a
    document, under ``room`` ids, go to its group: a document of any length costs its group little. ``with_ids`` adds the
    piece's ids as an array."""
    groups = max(1, -(-docs.count() // group_docs))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        for batch in batches:
            for lo, hi in row_ranges(utf8(batch.column(2))[1], RANGE):
                ids, ends = with_end(*enc.ids(batch.column(2).slice(lo, hi - lo)), end_id)
                n, wide = np.diff(ends), ids.astype("<u4")
                pieces = -(-n // room)
                row = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * room
                length = np.minimum(n[row] - start, room)
                at = ends[row] + start
                full = length == room
                crc = [zlib.crc32(wide[a:b]) if f else None for a, b, f in zip(at.tolist(), (at + length).tolist(), full.tolist(), strict=True)]
                held = byte_column(ids[np.repeat(~full | with_ids, length)], np.concatenate([[0], np.cumsum(np.where(~full | with_ids, length, 0))]) * enc.dtype.itemsize)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(of), batch.column(1).slice(lo, hi - lo).take(of), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), held], names=["part", *NAMES[:5], "ids"])

    def one_group(table: pa.Table) -> pa.Table:
        dtype, part = encoder(tokenizer, keeps_space).dtype, table["part"][0].as_py()
        table = table.sort_by([(c, "ascending") for c in (*NAMES[:5], "ids")])  # equal rows in any order give equal pieces
        own = {c: table[c].to_numpy() for c in ("start", "length", "doc_tokens")}
        full = np.flatnonzero(own["length"] == room)
        rests = np.flatnonzero(own["length"] < room)
        ids = [np.frombuffer(x.as_buffer(), dtype).astype("<u4") for x in table["ids"].take(pa.array(rests)).combine_chunks()]
        placed = [(i, s, n, k, at) for k, b in enumerate(pack([*map(len, ids)], room), len(full)) for at, (i, s, n) in _offsets(b)]
        item, start, length, k, at = np.array(placed, np.int64).reshape(-1, 5).T
        crc = np.array([zlib.crc32(ids[i][s : s + n]) for i, s, n, _, _ in placed], np.int64)
        both = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int64))
        row = rests[item]
        doc_id = table["doc_id"].combine_chunks().take(pa.array(np.concatenate([full, row])))
        cols = [doc_id, both(own["start"][full], own["start"][row] + start), both(own["length"][full], length), both(table["ids_crc32"].to_numpy()[full], crc), both(own["doc_tokens"][full], own["doc_tokens"][row]), both((part << 32) + np.arange(len(full)), (part << 32) + k), both(np.zeros(len(full)), at)]
        out = pa.table(cols, names=NAMES)
        if not with_ids:
            return out
        whole = [np.frombuffer(x.as_buffer(), dtype).tolist() for x in table["ids"].take(pa.array(full)).combine_chunks()]
        return out.append_column("ids", pa.array([*whole, *(ids[i][s : s + n].tolist() for i, s, n, _, _ in placed)], pa.list_(pa.int64())))

    dealt = docs.select(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = dealt.mapInArrow(tokens, "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return encoded.repartition(max(min(groups, 2 * width(docs.sparkSession)), 2), "part").groupBy("part").applyInArrow(one_group, PIECES + (", ids array<long>" if with_ids else ""))


def _offsets(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """Where each piece of a sequence begins in it."""
    at = 0
    for x in pieces:
        yield at, x
        at += x[2]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # long texts need little memory beside the JVM's heap
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
