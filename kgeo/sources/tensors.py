"""Model files: safetensors (also in shards), configuration, vocabularies, and what kind of thing a path is."""

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"F32": "<f4", "F64": "<f8", "I32": "<i4", "I64": "<i8", "F16": "<f2"}


def tensor_rows(data: bytes) -> Iterator[tuple[str, str, list[int], list[float]]]:
    """name, dtype, shape, values of a safetensors file; kinds that are not read give zeros."""
    n = struct.unpack("<Q", data[:8])[0]
    for name, x in sorted(json.loads(data[8 : 8 + n]).items()):
        if name == "__metadata__":
            continue
        part = data[8 + n + x["data_offsets"][0] : 8 + n + x["data_offsets"][1]]
        if x["dtype"] in _KINDS:
            v = np.frombuffer(part, _KINDS[x["dtype"]]).astype("<f4")
        elif x["dtype"] == "BF16":
            v = (np.frombuffer(part, "<u2").astype(np.uint32) << 16).view("<f4")
        else:
            v = np.zeros(int(np.prod(x["shape"])), "<f4")
        yield name, x["dtype"], x["shape"], v


def safetensors(spark: SparkSession, path: str) -> DataFrame:
    """path, name, dtype, shape, row, v: a row per row of each tensor (a vector is one row), so a matrix is spread."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                for name, dtype, shape, v in tensor_rows(bytes(data)):
                    m = v.reshape(-1, shape[-1]) if len(shape) > 1 else v.reshape(1, -1)
                    for lo in range(0, len(m), 4096):
                        part = m[lo : lo + 4096]
                        yield pd.DataFrame({"path": file, "name": name, "dtype": dtype, "shape": [shape] * len(part), "row": range(lo, lo + len(part)), "v": [*part]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path).select("path", "content").mapInPandas(run, "path string, name string, dtype string, shape array<long>, row long, v array<float>")


def shards(spark: SparkSession, index_path: str) -> DataFrame:
    """tensor, file of a shard index."""
    raw = spark.read.text(index_path, wholetext=True)
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.weight_map"), "map<string,string>")).alias("tensor", "file"))


def layer_roles(names: DataFrame) -> DataFrame:
    """``names``: name. Layer and role (q, k, v, o, gate, up, down) by the first part of the name that matches."""
    role = F.when(F.col("name").rlike(r"q_proj|\.query|\.q\."), "q").when(F.col("name").rlike(r"k_proj|\.key|\.k\."), "k").when(F.col("name").rlike(r"v_proj|\.value|\.v\."), "v").when(F.col("name").rlike(r"o_proj|attention\.output|out_proj|\.o\."), "o").when(F.col("name").rlike("gate|fc1|intermediate"), "gate").when(F.col("name").rlike("up_proj"), "up").when(F.col("name").rlike("down|fc2|output"), "down")
    return names.select("name", F.expr(r"try_cast(regexp_extract(name, '(?:layers?|h|blocks?)[._]([0-9]+)', 1) AS INT)").alias("layer"), role.alias("role")).filter("layer IS NOT NULL AND role IS NOT NULL")


#: Names under which token embeddings are stored, best first.
EMBEDDING_NAMES = ["model.embed_tokens.weight", "embeddings.word_embeddings.weight", "bert.embeddings.word_embeddings.weight", "transformer.wte.weight", "wte.weight", "shared.weight", "embed_tokens.weight"]


def embedding_name(names: DataFrame) -> DataFrame:
    """The best known name of an embedding matrix among ``names``."""
    order = F.array_position(F.array(*map(F.lit, EMBEDDING_NAMES)), F.col("name"))
    return names.filter(F.col("name").isin(EMBEDDING_NAMES)).agg(F.min_by("name", order).alias("name"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of vocab.txt (a token per line), vocab.json or tokenizer.json."""
    whole = spark.read.text(path, wholetext=True)
    if path.endswith(".txt"):
        return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("id", "token")).select("token", "id")
    inner = F.get_json_object("value", "$.model.vocab") if path.endswith("tokenizer.json") else F.col("value")
    return whole.select(F.explode(F.from_json(inner, "map<string,int>")).alias("token", "id"))


def config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def classify(paths: DataFrame) -> DataFrame:
    """``paths``: path. kind: safetensors, shard index, config, tokenizer, vocabulary, text or other."""
    n = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    return paths.withColumn("kind", F.when(F.endswith(n, F.lit(".safetensors")), "safetensors").when(F.endswith(n, F.lit(".index.json")), "shard index").when(n == "config.json", "config").when(n.isin("tokenizer.json", "tokenizer_config.json"), "tokenizer").when(n.isin("vocab.txt", "vocab.json"), "vocabulary").when(n.rlike(r"\.(txt|md|text)$"), "text").otherwise("other"))
