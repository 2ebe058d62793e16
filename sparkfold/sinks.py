"""Writers of result tables and artifacts."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions.expressions import gapped, length_normalised, sanitize, wrap_lines
from .functions.geometry import superpose
from .functions.lazy import pandas_udf
from .model import ATOMS, DUAL_COLUMNS, METRICS, MISSING, RESIDUES, SUMMARY_COLUMNS, FailedPrecondition

THREE = {v: k for k, v in RESIDUES.items()}


@pandas_udf("string")
def six_digits(v: pd.Series) -> pd.Series:
    """Six significant digits as C prints them; null is NA."""
    return v.map(lambda x: "NA" if x is None or x != x else f"{x:.6g}")


def summary(results: DataFrame, names: DataFrame, dual: bool = False, fasta: Column | None = None, pdb: Column | None = None) -> DataFrame:
    """The summary columns as text, in pair order once written: 21, or 25 with the soft and length-normalised scores.

    results: alignments with the metric panel; names: idx, input_id.
    """
    side = lambda s: names.select(F.col("idx").alias(f"{s}_index"), F.col("input_id").alias(f"{s}_id"))
    j = results.join(side("query"), "query_index").join(side("target"), "target_index")
    aligned = F.col("path.aligned_pairs")
    columns: dict[str, Column] = {
        "query_index": F.col("query_index").cast("string"), "target_index": F.col("target_index").cast("string"), "pair_id": F.concat("query_id", F.lit("__"), "target_id"),
        "raw_sw_score": six_digits(F.col("raw_sw_score")), "aligned_pairs": aligned.cast("string"), **{m: six_digits(F.col(f"metrics.{m}")) for m in METRICS},
        "fasta_path": fasta if fasta is not None else F.lit("NA"), "pdb_path": pdb if pdb is not None else F.lit("NA"),
    }
    order = list(SUMMARY_COLUMNS)
    if dual:
        extra = length_normalised(F.col("raw_sw_score"), aligned, F.col("query_length"), F.col("target_length"))
        columns |= dict(zip(DUAL_COLUMNS, (six_digits(F.col("soft_sw_score")), *map(six_digits, extra)), strict=True))
        at = order.index("raw_sw_score") + 1
        order[at:at] = DUAL_COLUMNS
    return j.select("pair_index", *[columns[c].alias(c) for c in order])


def write_tsv(table: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated text with a header, in pair order across the part files; Spark's commit publishes all or nothing."""
    ordered = table.orderBy("pair_index").drop("pair_index")
    (ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def stream_rows(table: DataFrame, receive: Callable[[Row], bool | None]) -> int:
    """Hands rows to receive in pair order, a partition at a time; False from it stops. Returns the rows received."""
    n = 0
    for row in table.orderBy("pair_index").toLocalIterator():
        n += 1
        if receive(row) is False:
            break
    return n


def alignment_fasta(results: DataFrame, proteins: DataFrame, width: int = 80) -> DataFrame:
    """pair_index, name, fasta: the gapped sequences of both proteins; a protein without codes is an error."""
    side = lambda s: proteins.select(F.col("idx").alias(f"{s}_index"), F.col("input_id").alias(f"{s}_id"), F.col("codes").alias(f"{s}_codes"))
    j = results.join(side("query"), "query_index").join(side("target"), "target_index")
    row = lambda s: gapped(F.coalesce(F.col(f"{s}_codes"), F.raise_error(F.concat(F.lit("no residue codes: "), f"{s}_id")).cast("string")), F.col(f"path.steps.{s}_index"))
    record = lambda s: F.concat(F.lit(">"), sanitize(F.col(f"{s}_id")), F.lit("\n"), wrap_lines(row(s), width), F.lit("\n"))
    return j.select("pair_index", F.concat(sanitize(F.col("query_id")), F.lit("__"), sanitize(F.col("target_id"))).alias("name"), F.concat(record("query"), record("target")).alias("fasta"))


def pdb_text(query: dict, target: dict, path: list, remarks: list[str]) -> str:
    """Both structures as two models, the target moved onto the query; needs three matched observed CA atoms."""
    q, t = (np.asarray(s["xyz"], float).reshape(-1, 5, 3) for s in (query, target))
    qs, ts = (np.asarray(s["sources"], int).reshape(-1, 5) for s in (query, target))
    both = [(s["query_index"], s["target_index"]) for s in path if s["query_index"] >= 0 and s["target_index"] >= 0]
    both = [(a, b) for a, b in both if qs[a, 1] == 1 and ts[b, 1] == 1]
    if len(both) < 3:
        raise FailedPrecondition("fewer than three matched CA atoms")
    r, shift, rmsd = superpose(t[[b for _, b in both], 1], q[[a for a, _ in both], 1])
    lines = [f"REMARK   1 {x}" for x in [*remarks, f"RMSD {rmsd:.6g}"]]
    for model, (s, x, src) in enumerate(((query, q, qs), (target, t @ r.T + shift, ts)), 1):
        lines.append(f"MODEL     {model:4d}")
        serial = 0
        for k, code in enumerate(s["codes"]):
            for a, atom in enumerate(ATOMS):
                if src[k, a] == MISSING:
                    continue
                serial += 1
                p = x[k, a]
                lines.append(f"ATOM  {serial % 100000:5d}  {atom:<3s} {THREE.get(code, 'UNK'):>3s} {'AB'[model - 1]}{(k + 1) % 10000:4d}    {p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}{1:6.2f}{0:6.2f}          {atom[0]:>2s}")
        lines += ["TER", "ENDMDL"]
    return "\n".join([*lines, "END", ""])


def superposed_pdb(results: DataFrame, structures: DataFrame) -> DataFrame:
    """pair_index, name, pdb; null where fewer than three CA atoms match. structures: idx, input_id, codes, xyz, sources."""
    side = lambda s: structures.select(F.col("idx").alias(f"{s}_index"), F.struct("input_id", "codes", "xyz", "sources").alias(s))
    j = results.join(side("query"), "query_index").join(side("target"), "target_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out.append(pdb_text(r.query, r.target, r.steps, [f"QUERY {r.query['input_id']}", f"TARGET {r.target['input_id']}"]))
                except FailedPrecondition:
                    out.append(None)
            yield pd.DataFrame({"pair_index": pdf["pair_index"], "name": pdf["name"], "pdb": out})

    named = j.select("pair_index", F.concat(sanitize(F.col("query.input_id")), F.lit("__"), sanitize(F.col("target.input_id"))).alias("name"), "query", "target", F.col("path.steps").alias("steps"))
    return named.mapInPandas(run, "pair_index long, name string, pdb string")


def write_texts(table: DataFrame, column: str, path: str) -> None:
    """One text of each row, in folders by name; rows without one are left out."""
    table.where(F.col(column).isNotNull()).select("name", column).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def design_fasta(designs: DataFrame) -> DataFrame:
    """input_id, sample, fasta, with score, seed, temperature and order in the header."""
    head = F.format_string(">design_%d score=%s seed=%d T=%s decode_order=%s", F.col("sample") + 1, six_digits(F.col("score")), F.col("seed"), six_digits(F.col("temperature")), F.array_join(F.col("decode_order").cast("array<string>"), ","))
    return designs.select("input_id", "sample", F.concat(head, F.lit("\n"), wrap_lines(F.col("sequence")), F.lit("\n")).alias("fasta"))


def log_probs_npz(log_probs: list[list[list[float]]]) -> bytes:
    """An uncompressed archive with one float32 array [N, L, 21]."""
    out = io.BytesIO()
    np.savez(out, log_probs=np.asarray(log_probs, "<f4"))
    return out.getvalue()


def score_table(results: DataFrame) -> DataFrame:
    """The nine columns of a scored alignment, as text for TSV."""
    names = ("coverage_query", "coverage_target", "coverage_mean", "identity", "rmsd", "tm_score_query", "tm_score_target", "lddt")
    return results.select(F.col("path.aligned_pairs").cast("string").alias("aligned_pairs"), *[six_digits(F.col(f"metrics.{m}")).alias(m) for m in names])


def score_json(results: DataFrame) -> DataFrame:
    names = ("coverage_query", "coverage_target", "coverage_mean", "identity", "rmsd", "tm_score_query", "tm_score_target", "lddt")
    return results.select(F.to_json(F.struct(F.col("path.aligned_pairs").alias("aligned_pairs"), *[F.col(f"metrics.{m}").alias(m) for m in names]), {"ignoreNullFields": "false"}).alias("json"))


def encode_summary(encoded: DataFrame) -> DataFrame:
    return encoded.select("input_id", F.col("length").alias("rows"), "dim")


def write_cache(cache_path: str, encoded: DataFrame) -> None:
    """Adds finite embeddings (key, length, dim, embedding) to a cache table; keys that it has already stay."""
    spark = encoded.sparkSession
    new = encoded.where(~F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).select("key", "length", "dim", "embedding").dropDuplicates(["key"])
    try:
        new = new.join(spark.read.parquet(cache_path).select("key"), "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(cache_path)
