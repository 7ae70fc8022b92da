"""Repeated substrings of texts: overlapping counts by levels, association measures, selection, tiling."""

import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kgeo.functions import text as t
from kgeo.functions.scoring import npmi
from kgeo.operators.ml import _written


#: Characters of one key up to which its repeats are found within one row group; longer ones are counted level by level.
MOST = 2_000_000


def _by_key(docs: DataFrame, key: str, run: Callable[[list, list[str]], Iterator[pa.RecordBatch]], schema: str, least: int = 1 << 19) -> DataFrame:
    """``run`` gets the keys and texts of whole keys, about ``least`` characters at a time. Nulls and empty texts are left out."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size >= least and k != keys[-1]:
                    yield from run(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(x)
                size += len(x)
        if keys:
            yield from run(keys, texts)

    rows = docs.select(key, "text").filter("text <> ''")
    return rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).mapInArrow(batched, schema)


def _levels(keys: list, texts: list[str], max_n: int, min_frequency: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per n: a place of each repeated substring, the least number of characters before it in a text, its frequency, whether
    it is a run of one character, and all places of all. Places count the texts' characters, with ``max_n`` ends after each text. Equal keys follow one another.

    All places are sorted once by the ``max_n`` characters from them on; those of a shorter substring then lie together."""
    joined = np.frombuffer("".join(x + "\0" * max_n for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([*map(len, texts)], np.int64)
    inside = np.ones(len(joined), bool)
    inside[(np.cumsum(sizes + max_n)[:, None] - np.arange(1, max_n + 1)).ravel()] = False
    kinds = np.flatnonzero(np.bincount(joined[inside]))
    codes = np.where(inside, np.searchsorted(kinds, joined) + 1, 0).astype(np.uint64)  # 0: after the end
    new = np.array([True, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))])
    of = np.repeat(np.cumsum(new) - 1, sizes + max_n)
    begins = np.repeat(np.cumsum(sizes + max_n) - sizes - max_n, sizes + max_n)
    at, bits = np.flatnonzero(inside), int(len(kinds)).bit_length()
    words, word, room = [of[at].astype(np.uint64)], None, 64 - int(of[-1]).bit_length()
    word = words.pop()
    for i in range(max_n):
        if room < bits:
            words.append(word)
            word, room = np.zeros(len(at), np.uint64), 64
        word = word << np.uint64(bits) | codes[at + i]
        room -= bits
    words.append(word)
    at = at[np.argsort(words[0]) if len(words) == 1 else np.lexsort(words[::-1])]
    same = of[at[1:]] == of[at[:-1]]
    for n in range(1, max_n + 1):
        last = codes[at + n - 1]
        same = same & (last[1:] == last[:-1])
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        count = np.diff(np.append(starts, len(at)))
        good = (count >= min_frequency) & (last[starts] > 0)
        first = np.minimum.reduceat(at, starts)[good]
        before = first - begins[first] if new.all() else np.minimum.reduceat(at - begins[at], starts)[good]
        kept = np.repeat(good, count)
        at, same = at[kept], same[kept[1:] & kept[:-1]] if good.all() else np.repeat(True, max(0, int(kept.sum()) - 1))
        if not len(at):
            return
        if not good.all():
            same[np.cumsum(count[good])[:-1] - 1] = False
        run = np.full(len(first), n > 1)
        for i in range(1, n):
            run &= codes[first + i] == codes[first]
        yield n, first, before, count[good], run, at


def ngrams(docs: DataFrame, max_n: int = 8, min_frequency: int = 2, key: str = "doc_id") -> DataFrame:
    """Per document: ngram, n, freq, first, is_rle, signature of every substring of 1 to ``max_n`` characters that occurs at
    least ``min_frequency`` times, overlaps counted. Rows of one key are one document, its texts apart.

    A document's texts lie in one task, where one sort of their places counts all lengths; documents of over MOST characters
    are counted level by level over all tasks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([*map(len, texts)], np.int64)
        begins = np.cumsum(sizes + max_n) - sizes - max_n
        raw = "".join(x + "\0" * max_n for x in texts).encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        byte = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data)) if len(data) > len(begins) * max_n + sizes.sum() else None
        names = pa.array(keys, docs_key)
        for n, first, before, count, runs, _ in _levels(keys, texts, max_n, min_frequency):
            for lo in range(0, len(first), 100_000):
                p = first[lo : lo + 100_000]
                text = np.searchsorted(begins, p, "right") - 1
                low, high = (p, p + n) if byte is None else (byte[p], byte[p + n])
                ends = np.concatenate([[0], np.cumsum(high - low)])
                grams = data[np.repeat(low - ends[:-1], high - low) + np.arange(ends[-1])]
                column = pa.Array.from_buffers(pa.string(), len(p), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(grams)])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(text)), column, pa.array(np.full(len(p), n, np.int32)), pa.array(count[lo : lo + len(p)]), pa.array(before[lo : lo + len(p)].astype(np.int32)), pa.array(runs[lo : lo + len(p)])], names=[key, "ngram", "n", "freq", "first", "is_rle"])

    docs_key = to_arrow_type(docs.schema[key].dataType)
    short, long = _split(docs, key)
    out = _by_key(short, key, run, f"{key} {kind}, ngram string, n int, freq long, first int, is_rle boolean")
    if long is not None:
        out = out.unionByName(_ngrams_by_level(long, max_n, min_frequency, key))
    return out.withColumn("signature", t.pattern(F.col("ngram")))


def _split(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with up to MOST characters, and the others, if there are any. Only a number per long key is looked at."""
    at = F.xxhash64(key).alias("_at")
    long = docs.groupBy(at).agg(F.sum(F.length("text")).alias("_size")).filter(F.col("_size") > MOST).select("_at")
    if long.isEmpty():
        return docs, None
    held = docs.select("*", at)
    return held.join(long, "_at", "left_anti").drop("_at"), held.join(long, "_at", "left_semi").drop("_at")


def _ngrams_by_level(docs: DataFrame, max_n: int, min_frequency: int, key: str) -> DataFrame:
    """As ``ngrams`` without the signature, for documents of any length: a place is looked at again only if the shorter
    substring there is frequent, so rows shrink with n. A place carries the ``max_n`` characters from it on, not its text."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch[key], batch["text"], strict=True):
                for lo in range(0, len(text or ""), 50_000):
                    at = range(lo, min(lo + 50_000, len(text)))
                    yield pd.DataFrame({key: [doc] * len(at), "pos": [i + 1 for i in at], "ahead": [text[i : i + max_n] for i in at]})

    chars = docs.select(key, "text").mapInPandas(places, f"{key} {docs.schema[key].dataType.simpleString()}, pos int, ahead string")
    out = None
    for n in range(1, max_n + 1):
        at = chars.filter(F.length("ahead") >= n).withColumn("ngram", F.substring("ahead", 1, n))
        level = at.groupBy(key, "ngram").agg(F.count("*").alias("freq"), F.min("pos").alias("first")).filter(F.col("freq") >= min_frequency)
        made = level.select(key, "ngram", F.lit(n).alias("n"), "freq", (F.col("first") - 1).alias("first"))
        out = made if out is None else out.unionByName(made)
        chars = at.join(level.select(key, "ngram"), [key, "ngram"], "left_semi").drop("ngram")
    return out.withColumn("is_rle", t.is_run(F.col("ngram")))


def tile_repeats(docs: DataFrame, max_n: int = 8, min_frequency: int = 2, key: str = "doc_id") -> DataFrame:
    """Each text that is not empty cut from the left into the longest of its own document's repeated substrings (``ngrams``),
    single characters else: key, pieces (array, in order). As ``tile`` with those, without a row for each of them."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        longest = np.ones(sum(map(len, texts)) + max_n * len(texts), np.int32)
        for n, *_, at in _levels(keys, texts, max_n, min_frequency):
            longest[at] = n
        begin, pieces, ends = 0, [], [0]
        for text in texts:
            steps, at, size = longest[begin : begin + len(text)].tolist(), 0, len(text)
            while at < size:
                pieces.append(text[at : at + steps[at]])
                at += steps[at]
            ends.append(len(pieces))
            begin += size + max_n
        yield pa.RecordBatch.from_arrays([pa.array(keys, docs_key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces, pa.string()))], names=[key, "pieces"])

    docs_key = to_arrow_type(docs.schema[key].dataType)
    short, long = _split(docs, key)
    out = _by_key(short, key, run, f"{key} {kind}, pieces array<string>")
    if long is None:
        return out
    cut = tile(long, _ngrams_by_level(long, max_n, min_frequency, key).select(key, "ngram"), max_n, key)
    return out.unionByName(cut.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]).alias("pieces")))


def word_ngrams(words: DataFrame, n: int, min_frequency: int = 2) -> DataFrame:
    """``words``: doc_id, pos, token. Corpus-wide counts of ``n`` tokens in a row: gram, freq."""
    grams = words
    for i in range(1, n):
        nxt = words.select("doc_id", (F.col("pos") - i).alias("pos"), F.col("token").alias(f"t{i}"))
        grams = grams.join(nxt, ["doc_id", "pos"])
    return grams.groupBy(F.concat_ws(" ", "token", *[f"t{i}" for i in range(1, n)]).alias("gram")).agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_frequency)


#: As ``text.tokens``.
_SINGLE = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), t.SINGLE)
_TOKEN = re.compile(f"[{_SINGLE}]|[^ \t\n\r{_SINGLE}]+")


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])) + 1])


def _pack(names: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows of codes (0: none, else 1 + a place in ``names``) with counts, as one compressed block with its own names. The first
    column ascends and is held as differences, bytes of one weight together."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    new = np.zeros(len(names) + 1, np.int32)
    new[used] = np.arange(1, len(used) + 1)
    small = [np.ascontiguousarray((new[x] if k else np.diff(new[x], prepend=np.int32(0))).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for k, x in enumerate(columns)]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(("\n".join(names.take(pa.array(used - 1)).to_pylist()), small, counts.astype(np.min_scalar_type(int(counts.max()))))))


def _unpack(blocks: list[bytes]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The rows of several blocks with the names of all."""
    names, columns, counts, sizes = [], [], [], []
    for held, small, n in (pickle.loads(zstandard.ZstdDecompressor().decompress(x)) for x in blocks):
        names += held.split("\n")
        sizes.append(held.count("\n") + 1)
        whole = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64) for x in small]
        columns.append([np.cumsum(whole[0]), *whole[1:]])
        counts.append(n.astype(np.int64))
    coded = pa.array(names, pa.string()).dictionary_encode()
    new = coded.indices.to_numpy().astype(np.int64) + 1
    maps = [np.concatenate([[0], x]) for x in np.split(new, np.cumsum(sizes)[:-1])]
    return coded.dictionary, [np.concatenate([m[c[k]] for m, c in zip(maps, columns, strict=True)]) for k in range(len(columns[0]))], np.concatenate(counts)


def _dealt(docs: DataFrame, rows_of: Callable[[np.ndarray, np.ndarray], dict[int, list[np.ndarray]]], most: int = 12_000_000) -> DataFrame:
    """Blocks of counted rows of token codes, sorted by part: part, kind, block. ``rows_of`` gets the codes of the tokens and the
    numbers of their documents and gives, per kind, columns of which the first two, in either order, or the only one say where a row goes.

    Texts are cut into tokens in the task that reads them; equal rows of a task are one, and a row of a hundred bytes or so of
    JVM memory is a few bytes of a block here. A document's tokens stay together."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(tokens: list[str], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)  # names that stand in order compress to half
        names, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(1, len(order) + 1)
        hashes = np.array([0, *(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names.to_pylist())], np.uint64)
        out = []
        for kind, columns in rows_of(place[coded.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)).items():
            if not len(columns[0]):
                continue
            mixed = hashes[columns[0]] if len(columns) == 1 else hashes[columns[0]] + hashes[columns[1]]
            part = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
            wide = len(names) + 1
            keys = [part]
            for i in range(0, len(columns), 2):
                keys.append(columns[i] * wide + columns[i + 1] if i + 1 < len(columns) else columns[i])
            order = np.lexsort(keys[::-1])
            keys, columns = [x[order] for x in keys], [x[order] for x in columns]
            starts = _runs(*keys)
            counts, part, columns = np.diff(np.append(starts, len(order))), keys[0][starts], [x[starts] for x in columns]
            cuts = _runs(part)
            out += [(int(part[lo]), kind, _pack(names, [x[lo:hi] for x in columns], counts[lo:hi])) for lo, hi in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, chars = [], [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                found = _TOKEN.findall(x)
                if not found:
                    continue
                tokens += found
                sizes.append(len(found))
                chars += len(x)
                if chars >= most:
                    yield from blocks(tokens, sizes)
                    tokens, sizes, chars = [], [], 0
        if tokens:
            yield from blocks(tokens, sizes)

    made = docs.select("text").filter("text IS NOT NULL").mapInArrow(run, "part int, kind int, block binary")
    return made.repartition(parts // 2, "part").sortWithinPartitions("part")


def _each_part(dealt: DataFrame, runs: dict[int, Callable[[pa.Array, list[np.ndarray], np.ndarray], pa.RecordBatch]], schema: str) -> DataFrame:
    """The function of its kind gets the names, rows and counts of each part's blocks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = {}, None
        for b in batches:
            for part, kind, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if part != last:
                    yield from (runs[k](*_unpack(x)) for k, x in held.items())
                    held, last = {}, part
                held.setdefault(kind, []).append(block.as_py())
        yield from (runs[k](*_unpack(x)) for k, x in held.items())

    return dealt.mapInArrow(parts, schema)


def association(docs: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Pairs of adjacent tokens of ``docs`` (text; a row is a document): freq, npmi, and the entropies of what stands left and
    right of the pair (exact, not sampled). Places of pairs go through one exchange, in blocks, with both their neighbours;
    frequent pairs, and each token's counts, are written."""

    def rows_of(ids: np.ndarray, doc: np.ndarray) -> dict[int, list[np.ndarray]]:
        same = doc[1:] == doc[:-1]
        at = np.flatnonzero(same)
        left = np.concatenate([[False], same])[at]
        right = np.concatenate([same, [False]])[at + 1]
        a, b = ids[at], ids[at + 1]
        return {0: [a, b, np.where(left, ids[at - 1], 0), np.where(right, ids[np.minimum(at + 2, len(ids) - 1)], 0)], 1: [a], 2: [b]}

    def batch(kind: int, a: pa.Array, b: pa.Array | None, n: np.ndarray, *entropies: np.ndarray) -> pa.RecordBatch:
        floats = [pa.array(x) for x in entropies] or [pa.nulls(len(n), pa.float64())] * 2
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), a, pa.nulls(len(n), pa.string()) if b is None else b, pa.array(n.astype(np.int64)), *floats], names=["kind", "a", "b", "freq", "left_entropy", "right_entropy"])

    def pairs(names: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        wide = len(names) + 1
        pair, of = np.unique(columns[0] * wide + columns[1], return_inverse=True)
        freq = np.bincount(of, counts, len(pair)).astype(np.int64)
        often = freq >= min_frequency
        kept = often[of]  # rarer pairs need no entropy
        new, counts, sides = (np.cumsum(often) - 1)[of[kept]], counts[kept], [c[kept] for c in columns[2:]]
        pair, freq = pair[often], freq[often]
        return batch(0, *(names.take(pa.array(x - 1)) for x in np.divmod(pair, wide)), freq, *(entropy(new, c, counts, len(pair), wide) for c in sides))

    def entropy(pair: np.ndarray, side: np.ndarray, counts: np.ndarray, n: int, wide: int) -> np.ndarray:
        there = side > 0
        seen, at = np.unique(pair[there] * wide + side[there], return_inverse=True)
        each = np.bincount(at, counts[there], len(seen))
        total, sums = (np.bincount(seen // wide, x, n) for x in (each, each * np.log2(each)))
        return np.where(total > 0, np.log2(np.maximum(total, 1)) - sums / np.maximum(total, 1), 0.0)

    def single(kind: int) -> Callable[[pa.Array, list[np.ndarray], np.ndarray], pa.RecordBatch]:
        def run(names: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
            token, of = np.unique(columns[0], return_inverse=True)
            return batch(kind, names.take(pa.array(token - 1)), None, np.bincount(of, counts, len(token)))

        return run

    counted, _ = _written(_each_part(_dealt(docs, rows_of), {0: pairs, 1: single(1), 2: single(2)}, "kind int, a string, b string, freq long, left_entropy double, right_entropy double"))
    of_kind = lambda kind, token, name: counted.filter(f"kind = {kind}").select(F.col("a").alias(token), F.col("freq").alias(name))
    out = counted.filter("kind = 0").drop("kind").join(of_kind(1, "a", "na"), "a").join(of_kind(2, "b", "nb"), "b")
    out = out.crossJoin(counted.filter("kind = 1").agg(F.sum("freq").alias("total")))  # one row
    share = lambda n: F.col(n) / F.col("total")
    return out.select("a", "b", "freq", npmi(share("freq"), share("na"), share("nb")).alias("npmi"), "left_entropy", "right_entropy")


def mentioned_pairs(docs: DataFrame) -> DataFrame:
    """Unordered pairs (a < b) of neighbouring different tokens of ``docs`` (text), each counted once per document and direction
    of reading, as ``ingest.relations`` mentions them: a, b, n. One exchange, in blocks."""

    def rows_of(ids: np.ndarray, doc: np.ndarray) -> dict[int, list[np.ndarray]]:
        near = (doc[1:] == doc[:-1]) & (ids[1:] != ids[:-1])
        a, b, doc = ids[:-1][near], ids[1:][near], doc[1:][near]
        order = np.lexsort((b, a, doc))
        once = order[_runs(doc[order], a[order], b[order])]
        a, b = a[once], b[once]
        return {0: [np.minimum(a, b), np.maximum(a, b)]} if len(a) else {}

    def count(names: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        held = [x.encode("utf-8", "surrogatepass") for x in names.to_pylist()]
        order = np.array(sorted(range(len(held)), key=held.__getitem__), np.int64)
        rank, by_rank = np.argsort(order), names.take(pa.array(order))
        x, y = (rank[c - 1] for c in columns)
        pairs, at = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_inverse=True)
        each = [by_rank.take(pa.array(v)) for v in np.divmod(pairs, len(names))]
        return pa.RecordBatch.from_arrays([*each, pa.array(np.bincount(at, counts, len(pairs)).astype(np.int64))], names=["a", "b", "n"])

    return _each_part(_dealt(docs, rows_of), {0: count}, "a string, b string, n long")


def significant(measured: DataFrame, min_frequency: int = 2, min_npmi: float = 0.1, min_entropy: float = 0.5) -> DataFrame:
    return measured.filter((F.col("freq") >= min_frequency) & (F.col("npmi") >= min_npmi) & ((F.col("left_entropy") >= min_entropy) | (F.col("right_entropy") >= min_entropy)))


def adjacency(words: DataFrame, skip_equal: bool = True) -> DataFrame:
    """Unordered pairs of neighbouring tokens: a, b, n."""
    from pyspark.sql import Window

    nxt = words.select("token", F.lead("token").over(Window.partitionBy("doc_id").orderBy("pos")).alias("next")).filter("next IS NOT NULL")
    nxt = nxt.filter("token <> next") if skip_equal else nxt
    return nxt.groupBy(F.least("token", "next").alias("a"), F.greatest("token", "next").alias("b")).agg(F.count("*").alias("n"))


def tile(docs: DataFrame, known: DataFrame, max_n: int = 8, key: str = "doc_id") -> DataFrame:
    """Cuts each text from the left into the longest of its known n-grams (``known``: key, ngram), single characters else:
    key, pos, piece. Text and n-grams of a document go to one row; documents are independent."""
    held = docs.select(key, "text").join(known.groupBy(key).agg(F.collect_set("ngram").alias("grams")), key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, grams in zip(batch[key], batch["text"], batch["grams"], strict=True):
                have, at = set(() if grams is None else grams), 0
                while text and at < len(text):
                    n = next((n for n in range(min(max_n, len(text) - at), 1, -1) if text[at : at + n] in have), 1)
                    rows.append((doc, at, text[at : at + n]))
                    at += n
            yield pd.DataFrame(rows, columns=[key, "pos", "piece"])

    return held.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, pos int, piece string")
