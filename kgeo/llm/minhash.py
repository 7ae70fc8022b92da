"""MinHash near-duplicates with tensored banding.

Two small collections of hashes are computed per document, each hash made of a few minhashes. A table's key is a pair of one
hash from each collection, so ``m`` hashes on either side serve m * m tables, with the minhashes of 2 * m. Documents that meet
in a table are linked into candidate groups, and in each group the full shingle sets decide, word by word: hashes only
choose what is compared. Texts of equal words are one row throughout."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.chunks import slices
from kgeo.llm.graph import by_group, connected_components, pair_blocks
from kgeo.llm.shingles import mix, normal, shingle_sets
from kgeo.llm.storage import lean, materialize


def collection_size(similarity: float, minhashes: int, miss: float) -> int:
    """Hashes per collection with which a pair of that similarity meets in no table with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**minhashes)))


def collections(sets: np.ndarray, sizes: np.ndarray, m: int, minhashes: int, seed: int) -> np.ndarray:
    """2 * m hashes of each non-empty set, the left collection first; rows of empty sets are zero."""
    rng = np.random.default_rng(seed)
    mul, add = (rng.integers(0, 1 << 32, 2 * m * minhashes, dtype=np.uint32) | np.uint32(1) for _ in range(2))
    salt = rng.integers(0, 1 << 64, 2 * m, dtype=np.uint64)
    place = rng.integers(0, 1 << 64, minhashes, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sizes), 2 * m), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        x = (sets >> np.uint64(32)).astype(np.uint32)
        for c in range(2 * m):
            key = np.full(len(full), salt[c])
            for j in range(minhashes):
                i = c * minhashes + j
                key += np.minimum.reduceat((x ^ add[i]) * mul[i], starts).astype(np.uint64) * place[j]
            out[full, c] = mix(key)
    return out.view(np.int64)


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A star of edges for each group of sets connected by links of 100 * intersection >= percent * union, by exact counts.

    Rows of counts are computed for sets outside the largest group until all of those have one: then each pair of sets has
    been compared, or both are in the largest group."""
    n, sizes = len(sets), np.array([*map(len, sets)])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    kinds, code = np.unique(hashes, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(code, minlength=len(kinds)))
    begins = np.concatenate([[0], ends[:-1]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    weight = np.add.reduceat((ends - begins)[code], at[:-1]) if n else np.zeros(0)
    group, done, order = np.arange(n), np.zeros(n, bool), np.argsort(-weight, kind="stable")
    while True:
        waiting = order[~done[order] & (group[order] != np.bincount(group).argmax())]
        if not len(waiting):
            break
        x = waiting[0]
        own = code[at[x] : at[x + 1]]
        shared = np.bincount(np.concatenate([holders[b:e] for b, e in zip(begins[own], ends[own], strict=True)]), minlength=n)
        hits = np.flatnonzero(100 * shared >= percent * (sizes + sizes[x] - shared))
        merged = np.unique(group[hits])
        group[np.isin(group, merged)] = merged[0]
        done[x] = True
    first = {}
    for i, g in enumerate(group.tolist()):
        first.setdefault(g, []).append(i)
    return [(g[0], i) for g in first.values() for i in g[1:]]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, minhashes: int = 4, miss: float = 1e-4, seed: int = 41, block_shingles: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links: 100 * intersection >= percent * union of the sets of ``words``-word shingles of whole texts (A-Z lowered, words
    parted by ASCII white space; fewer words: the whole sequence is the one shingle). component_id is the smallest doc_id
    reachable by links. A pair at the threshold goes unmet with probability ``miss`` at most; links found are exact, by the
    words themselves. n_shingles is exact too. A text of any length is handled whole, by a worker that holds it.
    Null, empty and wordless texts have 0 shingles, no links and themselves as component. A null doc_id links with nothing:
    null component, kept. Rows that repeat a doc_id have one component together. Other columns are ignored."""
    m = collection_size(percent / 100, minhashes, miss)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal((x or "").encode()) for x in batch.column(2).to_pylist()]
            for lo, hi in slices(texts):
                _, sizes, hashes = shingle_sets(texts[lo:hi], words)
                keys = collections(hashes, sizes, m, minhashes, seed)
                digest = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in texts[lo:hi]]
                held = [pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * m), pa.array(np.ascontiguousarray(k).ravel())) for k in (keys[:, :m], keys[:, m:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes), pa.array(digest, pa.binary()), *held], names=["doc_id", "text_hash", "n_shingles", "digest", "left", "right"])

    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(whole.mapInArrow(lean(sketch), "doc_id long, text_hash long, n_shingles long, digest binary, left array<long>, right array<long>"), "sketches")
    reps = materialize(rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("_one"), F.first("n_shingles").alias("n_shingles"), F.first("left").alias("left"), F.first("right").alias("right")).select("digest", F.xxhash64("digest").alias("rep"), F.col("_one.doc_id").alias("doc_id"), F.col("_one.text_hash").alias("text_hash"), "n_shingles", "left", "right"), "distinct-texts")  # rep names the words: an id may have several texts

    # A table can only bring documents together that share both hashes of its key with another: others need no keys.
    single = reps.select("rep", F.posexplode(F.concat("left", "right")).alias("place", "hash"))
    shared = single.join(single.groupBy("hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("hash"), "hash").groupBy("rep").agg(F.collect_list(F.struct("place", "hash")).alias("held"))  # 2 * m at most
    side = lambda test: F.transform(F.filter("held", test), lambda x: x["hash"])
    tables = shared.select("rep", F.explode(F.flatten(F.transform(side(lambda x: x["place"] < m), lambda a: F.transform(side(lambda x: x["place"] >= m), lambda b: F.xxhash64(a, b))))).alias("key"))
    tables = materialize(tables, "tables")
    meeting = tables.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = connected_components(tables.join(meeting, "key").filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct())

    def verify(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for g in tables:
            ids, where = np.unique(g["rep"].to_numpy(), return_index=True)
            sets, sizes, _ = shingle_sets([normal(g["text"][int(i)].as_py().encode()) for i in where], words)
            edges += [(int(ids[a]), int(ids[b])) for a, b in linked(np.split(sets, np.cumsum(sizes)[:-1]), percent)]
            if len(edges) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])
                edges = []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])

    members = groups.withColumnRenamed("node", "rep").join(reps.select("rep", "doc_id", "text_hash", (F.col("n_shingles") + 200).alias("weight")), "rep")
    dealt = pair_blocks(members, "component", "rep", "weight", block_shingles)
    texts = whole.join(dealt, ["doc_id", "text_hash"])
    links = by_group(texts.select("component", "block_a", "block_b", "rep", "text"), "component", verify, "a long, b long")
    # From sets back to ids; an id with several sets connects them.
    owner = reps.select("rep", "doc_id")
    links = links.join(owner.select(F.col("rep").alias("a"), F.col("doc_id").alias("a_id")), "a").join(owner.select(F.col("rep").alias("b"), F.col("doc_id").alias("b_id")), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    several = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most").select("doc_id")
    own = rows.select("doc_id", "digest").join(several, "doc_id").join(reps.select("digest", F.col("doc_id").alias("first")), "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    classes = connected_components(links.unionByName(own)).withColumnRenamed("node", "doc_id")
    by_set = reps.select("digest", "doc_id").join(classes, "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(by_set, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table: shingles of 3 words, links at 85 of 100."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, percent=85)
