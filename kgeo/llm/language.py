"""Language identification: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

Features are the 2- and 3-grams of bytes of the lower-cased text, in which every run of ASCII other than letters is one
space; each is hashed to one of DIM places. A text's vector is log(1 + count) times the inverse document frequency,
scaled to length one. A text is as near to a language as to the nearest of its centroids, and is rejected where that
similarity is below the language's floor."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 1 << 13
_TABLE = np.full(256, 32, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    b = _TABLE[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    gap = b == 32
    b = b[np.concatenate([[True], ~(gap[1:] & gap[:-1])])].astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    shift = np.uint32(32 - DIM.bit_length() + 1)
    places = np.concatenate([(two * np.uint32(2246822519)) >> shift, (three * np.uint32(2654435761)) >> shift])
    return np.bincount(places, minlength=DIM)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    m = np.log1p(np.stack([counts(x) for x in texts]).astype(np.float32)) * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(m: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of length one; the first is a random row, each next the row least like those before."""
    picks = [int(np.random.default_rng(seed).integers(len(m)))]
    near = m @ m[picks[0]]
    while len(picks) < min(k, len(m)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, m @ m[picks[-1]])
    c = m[picks].copy()
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = m[own == j].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass(frozen=True)
class LanguageModel:
    """``centroids``: rows of the languages in ``owner``; ``floor``: least similarity by language, in the order of ``languages``."""

    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and the similarity; ties go to the language that sorts first."""
        near = vectors(texts, self.idf) @ self.centroids.T
        by = np.stack([near[:, self.owner == j].max(1) for j in range(len(self.languages))], 1)
        best = by.argmax(1)
        return best, np.clip(by[np.arange(len(texts)), best], 0, 1)


def fit(rows: DataFrame, sample_per_language: int = 400, centroids: int = 4, floor_share: float = 0.2, seed: int = 5) -> LanguageModel:
    """Learn from ``rows`` of text and lang; rows with null lang or without a letter teach nothing.

    Document frequencies come from all rows. Centroids come from about ``sample_per_language`` rows of each language,
    drawn at random by row, whatever the text, so one language's rows fit one task. The floor is ``floor_share`` times the
    similarity that 99 of 100 sampled rows of the language reach."""
    good = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                n += counts(x.as_py()) > 0
            docs += batch.num_rows
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held], pa.int32()), pa.array([docs, *n[held]], pa.int64())], names=["place", "n"])

    df = {r.place: r.n for r in good.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # DIM + 1 rows
    docs = df.pop(-1, 0)
    n = np.zeros(DIM)
    n[[*df]] = [*df.values()]
    idf = np.log((1 + docs) / (1 + n)).astype(np.float32) + np.float32(0.1)
    share = {r.lang: sample_per_language / r.n for r in good.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not share:
        return LanguageModel([], np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0), idf)
    chance = (F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)).cast("double")
    wanted = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, s))) for lang, s in share.items()])

    def one_language(key: tuple, table: pa.Table) -> pa.Table:
        m = vectors(table["text"].to_pylist(), idf)
        c = spherical_kmeans(m, centroids)
        floor = float(np.quantile((m @ c.T).max(1), 0.01)) * floor_share
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "centroid": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary()), "floor": pa.array([floor] * len(c), pa.float64())})

    learned = good.filter(chance < wanted).select("lang", "text").groupBy("lang").applyInArrow(one_language, "lang string, centroid binary, floor double").collect()
    learned.sort(key=lambda r: (r.lang, r.centroid))
    languages = sorted({r.lang for r in learned})
    return LanguageModel(languages, np.stack([np.frombuffer(r.centroid, "<f4") for r in learned]), np.array([languages.index(r.lang) for r in learned]), np.array([next(r.floor for r in learned if r.lang == x) for x in languages]), idf)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected (true where the text is far from every centroid).

    Null texts, texts without a letter, and all texts if nothing was learned: ``und``, score 0, rejected. Whole texts are
    judged. All columns and rows stay as they are; columns named like the three new ones are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for lo in range(0, len(texts), 64):
                part = [(i, x) for i, x in enumerate(texts.slice(lo, 64).to_pylist(), lo) if has_letter(x)] if model.languages else []
                if part:
                    at = [i for i, _ in part]
                    best, near = model.predict([x for _, x in part])
                    score[at], out[at] = near, near < model.floor[best]
                    for i, b in zip(at, best, strict=True):
                        lang[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(kept).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row's id, as text, has a CRC-32 that leaves 2 when divided by 4; a null id is neither held out nor learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, judged by a model of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
