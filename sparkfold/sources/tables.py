"""Sequences, pair lists, correspondences, arrays, weights and caches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import residue_letters, tokenize
from ..model import DataFormatError, InvalidArgument


def is_sequence_literal(text: Column) -> Column:
    """Whether an argument reads as residues rather than as a path."""
    return text.rlike(r"^[A-Za-z*-]+$")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, residues, tokens of FASTA records; the name is the whole header line, seq{n} (n from 1) if it is empty.

    Dropped signs (`-`, `*`, blanks) are dropped from residues and tokens alike, so indices agree.
    """
    return parse_fasta(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")))


def parse_fasta(texts: DataFrame) -> DataFrame:
    """read_fasta for a table of whole texts in `content`; `record` numbers a text's records from 0."""
    # a record starts at a `>` that begins a line; what stands before the first one is no record
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace("content", "\r", "")), "\n>"), lambda p, i: i > 0)
    rec = texts.select(F.posexplode(parts).alias("record", "part"))
    name = F.rtrim(F.substring_index("part", "\n", 1))
    body = F.when(F.instr("part", "\n") > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise("")
    named = F.when(name == "", F.concat(F.lit("seq"), (F.col("record") + 1).cast("string"))).otherwise(name)
    return rec.select(F.col("record").cast("bigint").alias("record"), named.alias("name"), residue_letters(body).alias("residues"), tokenize(body).alias("tokens"))


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    """pair_index, query_id, target_id of a two-column tab-separated list; blank and `#` lines don't count, others must have two fields."""
    return parse_pair_list(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")))


def parse_pair_list(texts: DataFrame) -> DataFrame:
    lines = F.filter(F.split("content", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    each = texts.select(F.posexplode(lines).alias("pair_index", "line")).withColumn("f", F.split("line", "\t"))
    ok = F.when(F.size("f") != 2, F.raise_error(F.concat(F.lit("not two fields: "), "line")).cast("string"))
    return each.select(F.col("pair_index").cast("bigint").alias("pair_index"), F.coalesce(ok, F.trim(F.col("f")[0])).alias("query_id"), F.trim(F.get("f", F.lit(1))).alias("target_id"))


def parse_correspondence(texts: DataFrame) -> DataFrame:
    """step, q, t of tab-separated whole numbers, -1 for a gap; a step of two gaps is an error."""
    lines = F.filter(F.split("content", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    f = F.split("line", r"\s+")
    each = texts.select(F.posexplode(lines).alias("step", "line")).select("step", "line", f[0].try_cast("int").alias("q"), F.get(f, F.lit(1)).try_cast("int").alias("t"), F.size(f).alias("n"))
    bad = (F.col("n") != 2) | F.col("q").isNull() | F.col("t").isNull() | (F.col("q") < -1) | (F.col("t") < -1) | ((F.col("q") == -1) & (F.col("t") == -1))
    return each.select("step", F.when(bad, F.raise_error(F.concat(F.lit("bad correspondence: "), "line")).cast("int")).otherwise(F.col("q")).alias("q"), "t")


def read_npy(spark: SparkSession, directory: str) -> DataFrame:
    """input_id, length, dim, embedding of .npy files: two axes, C order, little-endian float32; nothing is converted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(directory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows.append((path.rsplit("/", 1)[-1][:-4], *load_npy(content, path)))
            yield pd.DataFrame(rows, columns=["input_id", "length", "dim", "embedding"])

    return files.select("path", "content").mapInPandas(run, "input_id string, length int, dim int, embedding array<float>")


def load_npy(content: bytes, name: str) -> tuple[int, int, np.ndarray]:
    try:
        a = np.load(io.BytesIO(content), allow_pickle=False)
    except ValueError as e:
        raise DataFormatError(f"{name}: {e}") from None
    if a.dtype != np.dtype("<f4") or a.ndim != 2 or not a.size or not a.flags.c_contiguous:
        raise DataFormatError(f"{name}: want a non-empty C-ordered [L, D] array of float32, not {a.dtype} {a.shape}")
    return a.shape[0], a.shape[1], a.ravel()


def from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], codes: dict[str, str] | None = None) -> DataFrame:
    """Proteins from arrays in memory (anything with __array__, a buffer or DLPack), in the order given."""
    rows = []
    for k, (name, a) in enumerate(arrays.items()):
        m = np.from_dlpack(a) if not hasattr(a, "__array__") and hasattr(a, "__dlpack__") else np.asarray(a)
        m = np.ascontiguousarray(m, np.float32)
        if m.ndim != 2 or not m.size:
            raise InvalidArgument(f"{name}: want a non-empty [L, D] array")
        rows.append((k, name, m.shape[0], m.shape[1], m.ravel().tolist(), (codes or {}).get(name)))
    return spark.createDataFrame(rows, "idx long, input_id string, length int, dim int, embedding array<float>, codes string")


def weights_table(spark: SparkSession, tensors: dict[str, np.ndarray]) -> DataFrame:
    """name, shape, values, sha256: one row a tensor."""
    import hashlib

    rows = [(k, list(v.shape), np.ascontiguousarray(v, "<f4").ravel().tolist(), hashlib.sha256(np.ascontiguousarray(v, "<f4").tobytes()).hexdigest()) for k, v in tensors.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<float>, sha256 string")


def load_weights(table: DataFrame) -> dict[str, np.ndarray]:
    """The tensors of a weights table, checked by their digests; a model's weights fit the driver by definition."""
    import hashlib

    out = {}
    for r in table.collect():
        a = np.array(r["values"], "<f4")
        if r["sha256"] and hashlib.sha256(a.tobytes()).hexdigest() != r["sha256"]:
            raise DataFormatError(f"tensor {r['name']} is damaged")
        out[r["name"]] = a.reshape(r["shape"])
    return out


def read_safetensors(content: bytes) -> dict[str, np.ndarray]:
    """float32 tensors of a safetensors file: 8 bytes of header length, a JSON header, the data."""
    import json

    n = int.from_bytes(content[:8], "little")
    if not 2 <= n <= len(content) - 8:
        raise DataFormatError("bad safetensors header")
    out = {}
    for name, info in json.loads(content[8 : 8 + n]).items():
        if name == "__metadata__":
            continue
        a, b = info["data_offsets"]
        if info["dtype"] != "F32" or 8 + n + b > len(content):
            raise DataFormatError(f"tensor {name}: want whole F32 data")
        out[name] = np.frombuffer(content, "<f4", (b - a) // 4, 8 + n + a).reshape(info["shape"])
    return out


def cache_key(identity: str, length: Column, xyz: Column, sources: Column) -> Column:
    """SHA-256 of a model's identity and a structure's size, coordinates and sources."""
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return F.sha2(F.concat_ws("|", F.lit(identity), length.cast("string"), text(xyz), text(sources)).cast("binary"), 256)


def cached(structures: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their embedding, misses) of structures with `key`; damaged entries (not finite, wrong size) count as misses."""
    size = F.size("embedding")
    sound = cache.where((size > 0) & (F.pmod(size, F.col("dim")) == 0) & (size == F.col("length") * F.col("dim")) & ~F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    sound = sound.select("key", "dim", "embedding").dropDuplicates(["key"])
    return structures.join(sound, "key"), structures.join(sound, "key", "left_anti")


def cache_counts(structures: DataFrame, cache: DataFrame) -> DataFrame:
    """hits, misses, rejected."""
    hits, _ = cached(structures, cache)
    found = structures.select("key").join(hits.select("key", F.lit(1).alias("hit")).distinct(), "key", "left").join(cache.select("key", F.lit(1).alias("there")).distinct(), "key", "left")
    return found.agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"), (F.count("there") - F.count("hit")).alias("rejected"))
