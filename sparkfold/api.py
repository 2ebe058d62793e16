"""The engine: encode, pairwise, pair list, all against all, scoring of given alignments, design."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.registry import register
from .model import PACKAGES, PATH, InvalidArgument, package, resolve_gaps
from .operators import design as designer
from .operators import encoders
from .operators.alignment import AlignOptions, align_all, align_pairs
from .operators.metrics import with_panel
from .operators.pairs import referenced, resolve_pairs
from .sources import structures as st
from .sources import tables as tb


class Engine:
    """Workloads over DataFrames of proteins; results are lazy, and ordered only at a sink.

    Proteins have idx (place from 0), input_id, length and embedding, and codes, ca, ca_source where known. Encoders take
    weights by package name; without any they are synthetic ones of a fixed seed, whose scores mean nothing.
    """

    def __init__(self, spark: SparkSession, weights: dict[str, encoders.Weights] | None = None, functions: bool = True):
        self.spark = spark
        self.weights = dict(weights or {})
        if functions:
            register(spark)

    def _weights(self, name: str) -> encoders.Weights:
        p = package(name)
        if p.name not in self.weights:
            make = {"structure": encoders.synthetic_graph_weights, "sequence": encoders.synthetic_sequence_weights, "design": designer.synthetic_design_weights}
            self.weights[p.name] = make[p.kind]()
        return self.weights[p.name]

    # encoding

    def structures(self, path: str, ids: DataFrame | None = None, model: int | None = None, chain: str | None = None, infer: bool = True, modified_residues: bool = True) -> DataFrame:
        """Proteins of a directory of structure files, in path order; only those that ids name are read if it is given."""
        files = st.structure_files(self.spark, path, ids)
        residues = st.residues(st.read_atoms(files), infer, modified_residues, model, chain)
        st.check_residues(files, residues)
        return st.structure_proteins(residues)

    def encode_structures(self, structures: DataFrame, package_name: str = "structure-d64") -> DataFrame:
        return encoders.encode_structures(structures, self._weights(package_name))

    def encode_structures_cached(self, structures: DataFrame, cache: DataFrame, package_name: str = "structure-d64") -> DataFrame:
        """Embeddings from the cache where it has sound ones, from the encoder elsewhere; `key` is kept for write_cache."""
        keyed = structures.withColumn("key", tb.cache_key(package_name, F.col("length"), F.col("xyz"), F.col("sources")))
        hits, misses = tb.cached(keyed, cache)
        return self.encode_structures(misses, package_name).unionByName(hits)

    def encode_sequences(self, sequences: DataFrame, package_name: str = "sequence-320") -> DataFrame:
        return encoders.encode_sequences(sequences, self._weights(package_name))

    # alignment

    def _finish(self, alignments: DataFrame, proteins: DataFrame, options: AlignOptions, warnings: list[str], metrics: bool) -> DataFrame:
        out = with_panel(alignments, proteins) if metrics else alignments
        return out.withColumn("warnings", F.array(*map(F.lit, warnings)).cast("array<string>"))

    def _options(self, package_name: str, mode: str, gap_open: float | None, gap_extension: float | None, temperature: float | None) -> tuple[AlignOptions, list[str]]:
        o = AlignOptions.of(package_name, mode, gap_open, gap_extension, temperature)
        told: list[str] = []
        for m in ("hard", "soft") if mode == "both" else (mode,):
            told += resolve_gaps(package(package_name), m, gap_open, gap_extension)[1]
        return o, told

    def all_vs_all(self, proteins: DataFrame, package_name: str = "structure-d64", mode: str = "hard", gap_open: float | None = None, gap_extension: float | None = None, temperature: float | None = None, include_self: bool = False, metrics: bool = True, tile: int | None = None) -> DataFrame:
        o, told = self._options(package_name, mode, gap_open, gap_extension, temperature)
        return self._finish(align_all(proteins, o, include_self, tile), proteins, o, told, metrics)

    def pair_list(self, proteins: DataFrame, pairs: DataFrame, package_name: str = "structure-d64", mode: str = "hard", gap_open: float | None = None, gap_extension: float | None = None, temperature: float | None = None, metrics: bool = True) -> DataFrame:
        """Pairs by name, in the caller's order; gap overrides count on every route."""
        o, told = self._options(package_name, mode, gap_open, gap_extension, temperature)
        found = align_pairs(resolve_pairs(pairs, proteins), proteins, o)
        return self._finish(found, proteins, o, told, metrics)

    def pairwise(self, query: DataFrame, target: DataFrame, **options) -> DataFrame:
        """One query with one target, each a table of one protein."""
        both = query.select(F.lit(0).cast("bigint").alias("idx"), F.lit("query").alias("input_id"), *[c for c in query.columns if c not in ("idx", "input_id")])
        other = target.select(F.lit(1).cast("bigint").alias("idx"), F.lit("target").alias("input_id"), *[c for c in target.columns if c not in ("idx", "input_id")])
        proteins = both.unionByName(other, allowMissingColumns=True)
        n = proteins.count()
        if n != 2:
            raise InvalidArgument(f"want one query and one target, not {n} proteins")
        pairs = self.spark.createDataFrame([(0, "query", "target")], "pair_index long, query_id string, target_id string")
        return self.pair_list(proteins, pairs, **options)

    def pair_list_structures(self, directory: str, pairs: DataFrame, package_name: str = "structure-d64", **options) -> DataFrame:
        """Pairs of files by stem; only the files that a pair names are read, and each is encoded once."""
        ids = pairs.select(F.col("query_id").alias("input_id")).union(pairs.select("target_id")).distinct()
        return self.pair_list(self.encode_structures(self.structures(directory, ids), package_name), pairs, package_name, **options)

    def pair_list_sequences(self, sequences: DataFrame, pairs: DataFrame, package_name: str = "sequence-320", **options) -> DataFrame:
        """Pairs of sequences (record, name, residues, tokens). Scores carry no residue codes, so identity is null."""
        named = sequences.select(F.col("record").alias("idx"), F.col("name").alias("input_id"), "tokens")
        return self.pair_list(self.encode_sequences(referenced(pairs, named), package_name), pairs, package_name, **options)

    def all_vs_all_sequences(self, sequences: DataFrame, package_name: str = "sequence-320", **options) -> DataFrame:
        named = sequences.select(F.col("record").alias("idx"), F.col("name").alias("input_id"), "tokens")
        return self.all_vs_all(self.encode_sequences(named, package_name), package_name, **options)

    def score_alignment(self, proteins: DataFrame, steps: DataFrame) -> DataFrame:
        """The metric panel of given paths: steps (pair_index, query_index, target_index, step, q, t); nothing is aligned.

        A step of two gaps or out of range is an error.
        """
        size = lambda s: proteins.select(F.col("idx").alias(f"{s}_index"), F.col("length").alias(f"{s}_l"))
        j = steps.join(size("query"), "query_index").join(size("target"), "target_index")
        bad = ((F.col("q") < 0) & (F.col("t") < 0)) | (F.col("q") >= F.col("query_l")) | (F.col("t") >= F.col("target_l")) | (F.col("q") < -1) | (F.col("t") < -1)
        j = j.withColumn("q", F.when(bad, F.raise_error(F.lit("a step is out of range or has two gaps")).cast("int")).otherwise(F.col("q")))
        match = (F.col("q") >= 0) & (F.col("t") >= 0)
        score = F.col("residue_score") if "residue_score" in steps.columns else F.lit(0.0)
        path = j.groupBy("pair_index", "query_index", "target_index").agg(
            F.sort_array(F.collect_list(F.struct("step", F.col("q").alias("query_index"), F.col("t").alias("target_index"), score.cast("double").alias("residue_score")))).alias("s"),
            F.sum(match.cast("int")).cast("int").alias("aligned_pairs"),
            *[F.coalesce(f(F.when(match, F.col(c))), F.lit(-1)).cast("int").alias(f"{n}_{e}") for c, n in (("q", "query"), ("t", "target")) for f, e in ((F.min, "start"), (F.max, "end"))],
        )
        s = F.transform("s", lambda x: F.struct(x["query_index"].alias("query_index"), x["target_index"].alias("target_index"), x["residue_score"].alias("residue_score")))
        made = F.struct(s.alias("steps"), "aligned_pairs", "query_start", "query_end", "target_start", "target_end").cast(PATH)
        return with_panel(path.select("pair_index", "query_index", "target_index", made.alias("path")), proteins)

    # design

    def design(self, structures: DataFrame, package_name: str = "design-128", **options) -> DataFrame:
        if package(package_name).kind != "design":
            raise InvalidArgument(f"{package_name} doesn't design sequences")
        return designer.design(structures, self._weights(package_name), **options)

    # about

    def capabilities(self) -> DataFrame:
        rows = [(p.name, p.kind, p.dim, p.hard.open, p.hard.extension, p.soft.open, p.soft.extension, sorted(p.capabilities)) for p in PACKAGES.values()]
        return self.spark.createDataFrame(rows, "name string, kind string, dim int, hard_gap_open double, hard_gap_extension double, soft_gap_open double, soft_gap_extension double, capabilities array<string>")


def info() -> dict[str, str]:
    return {"version": __version__, "spark": pyspark.__version__, "python": platform.python_version(), "packages": ", ".join(PACKAGES)}
