"""Token ids as length-delimited binary records, with an offset index beside each shard.

Shard file: records in ascending id order; a record is
    length of the payload (unsigned 64 bit), masked checksum of those 8 bytes (unsigned 32 bit),
    payload (the ids, unsigned 16 or 32 bit), masked checksum of the payload (unsigned 32 bit),
all little-endian. A masked checksum is the CRC-32 rotated right by 15 bits plus 0xa282ead8, modulo 2**32, so that
checksums of data that hold checksums stay sound. Index file: one INDEX entry per record, for shuffled reads.
The manifest table has a row per shard. Shards whose writer was repeated or lost are not in it, and so not read."""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.chunks import encoder, row_ranges, utf8, with_end
from kgeo.llm.storage import fresh_dir, width

INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u8")])
MANIFEST = "shard int, data_file string, index_file string, n_docs long, n_tokens long, item_bytes int"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes | memoryview) -> tuple:
    """The record's pieces, in order."""
    head = len(payload).to_bytes(8, "little")
    return head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")


def unframe(data: memoryview, offset: int) -> tuple[memoryview, int]:
    """The payload at ``offset`` and where the next record begins; ValueError if a checksum does not hold."""
    head = bytes(data[offset : offset + 8])
    if masked(head) != int.from_bytes(data[offset + 8 : offset + 12], "little"):
        raise ValueError(f"length checksum at {offset}")
    end = offset + 12 + int.from_bytes(head, "little")
    payload = data[offset + 12 : end]
    if masked(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"payload checksum at {offset}")
    return payload, end + 4


def filesystem(uri: str):
    """The store of a URI or absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", keeps_space: bool = False, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` and write them to ``out_dir`` in ascending id order; returns the manifest (MANIFEST), also written there.

    Null texts are empty: their record holds the end id alone. Rows with a null id come first and keep a null id.
    Rows with equal ids are all written, ordered by text. An empty table gives no shard. Other columns are ignored. A text of any
    length is one record; a worker holds it and its ids, with others up to eight million bytes of text."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, stem = TaskContext.get().partitionId(), encoder(tokenizer, keeps_space), uuid.uuid4().hex
        out, index, at, total = None, [], 0, 0
        store, root = filesystem(out_dir)
        name = f"shard-{shard:06d}-{stem}"
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if out is None and len(texts):
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.rec")
            n = np.empty(len(texts), np.int64)
            offset = np.empty(len(texts), np.int64)
            for lo, hi in row_ranges(utf8(texts)[1]):
                tokens, ends = with_end(*enc.ids(texts.slice(lo, hi - lo)), end_id)
                raw, ends, framed = memoryview(tokens.tobytes()), ends * enc.dtype.itemsize, []
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), lo):
                    offset[i] = at
                    framed += frame(raw[a:b])
                    at += b - a + 16
                n[lo:hi] = np.diff(ends) // enc.dtype.itemsize
                out.write(b"".join(framed))
            entry = np.zeros(len(texts), INDEX)
            entry["doc_id"], entry["no_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            entry["offset"], entry["n_tokens"] = offset, n
            index.append(entry.tobytes())
            total += int(n.sum())
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(b"".join(index))
            n_docs = sum(map(len, index)) // INDEX.itemsize
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "data_file": [f"{out_dir}/{name}.rec"], "index_file": [f"{out_dir}/{name}.idx"], "n_docs": [n_docs], "n_tokens": [total], "item_bytes": pa.array([enc.dtype.itemsize], pa.int32())})

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(shards or width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def shard_records(records: str, index: str, item_bytes: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """A shard's (id, token ids), read by its index, one record in memory at a time."""
    store, path = filesystem(records)
    with filesystem(index)[0].open_input_stream(filesystem(index)[1]) as f:
        entries = np.frombuffer(f.read(), INDEX)
    with store.open_input_file(path) as f:
        for e in entries:
            size = int(e["n_tokens"]) * item_bytes + 16
            payload, _ = unframe(memoryview(f.read_at(size, int(e["offset"]))), 0)
            yield None if e["no_id"] else int(e["doc_id"]), np.frombuffer(payload, f"<u{item_bytes}")


def read_token_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32 bit). Shards are read side by side; each one's first position comes from the manifest, which has
    a row per shard. A damaged record raises."""
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest").collect())
    starts = np.cumsum([0] + [s.n_tokens for s in shards])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    rows = [(s.data_file, s.index_file, s.item_bytes, int(t)) for s, t in zip(shards, starts, strict=False)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4
        for batch in batches:
            for x in batch.to_pylist():
                at, out = x["start"], []
                for doc_id, ids in shard_records(x["data_file"], x["index_file"], x["item_bytes"]):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "data_file string, index_file string, item_bytes int, start long").repartition(len(rows)).mapInArrow(read, schema)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, encoded, written and read back."""
    import public_tokenizers

    out = fresh_dir(spark, "records")
    write_token_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_records(spark, out)
