"""Command line: python -m sparkfold.cli VERB ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import sinks
from .api import Engine, info
from .model import EXIT_CODES, EngineError, InvalidArgument
from .plans.session import session
from .sources import tables as tb


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkfold", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("info", help="versions and packages")

    def add(name: str, about: str, source: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        if source:
            g = c.add_mutually_exclusive_group(required=True)
            g.add_argument("--structures", help="a directory of structure files")
            g.add_argument("--sequences", help="a FASTA file")
            g.add_argument("--embeddings", help="a directory of .npy files")
        c.add_argument("--package")
        c.add_argument("--out", help="a folder for the table; it is printed if none is given")
        return c

    def add_alignment(c: argparse.ArgumentParser) -> None:
        c.add_argument("--mode", choices=["hard", "soft", "both"], default="hard")
        c.add_argument("--gap-open", type=float)
        c.add_argument("--gap-extension", type=float)
        c.add_argument("--temperature", type=float)
        c.add_argument("--dual-score", action="store_true", help="25 columns")
        c.add_argument("--alignments", help="a folder for gapped sequences")
        c.add_argument("--pdb", help="a folder for superposed structures")

    add("encode", "embeddings of inputs")
    pw = add("pairwise", "the first two inputs")
    pl = add("pair-list", "pairs by name")
    pl.add_argument("--pairs", required=True, help="a two-column tab-separated list")
    av = add("all-vs-all", "all pairs of inputs")
    av.add_argument("--include-self", action="store_true")
    for c in (pw, pl, av):
        add_alignment(c)
    sc = add("score-alignment", "metrics of a given alignment of two structures")
    sc.add_argument("--correspondence", required=True)
    sc.add_argument("--json", action="store_true")
    d = add("design", "sequences for backbones", source=False)
    d.add_argument("--structures", required=True)
    d.add_argument("--num-seqs", type=int, default=1)
    d.add_argument("--seed", type=int, default=0)
    d.add_argument("--temperature", type=float, default=0.1)
    d.add_argument("--order", choices=["random", "n_to_c"], default="random")
    d.add_argument("--backbone-noise", type=float, default=0.0)
    return p


def _proteins(e: Engine, a: argparse.Namespace):
    if a.structures:
        name = a.package or "structure-d64"
        return e.encode_structures(e.structures(a.structures), name), name
    if a.sequences:
        name = a.package or "sequence-320"
        s = tb.read_fasta(e.spark, a.sequences).select(F.col("record").alias("idx"), F.col("name").alias("input_id"), "tokens")
        return e.encode_sequences(s, name), name
    from pyspark.sql import Window

    npy = tb.read_npy(e.spark, a.embeddings)
    ids = npy.select("input_id", (F.row_number().over(Window.orderBy("input_id")) - 1).cast("bigint").alias("idx"))
    return npy.join(ids, "input_id"), a.package or "structure-d64"


def _emit(table, out: str | None) -> None:
    if out:
        sinks.write_tsv(table, out, single_file=True)
        return
    columns = [c for c in table.columns if c != "pair_index"]
    print("\t".join(columns))
    sinks.stream_rows(table, lambda r: print("\t".join("NA" if r[c] is None else str(r[c]) for c in columns)))


def run(a: argparse.Namespace) -> int:
    if a.verb == "info":
        for k, v in info().items():
            print(f"{k}\t{v}")
        return 0
    e = Engine(session(master=a.master))
    if a.verb == "design":
        made = e.design(e.structures(a.structures), a.package or "design-128", num_seqs=a.num_seqs, seed=a.seed, temperature=a.temperature, order=a.order, noise=a.backbone_noise)
        fasta = sinks.design_fasta(made).orderBy("input_id", "sample")
        if a.out:
            fasta.select(F.regexp_replace("fasta", "\n$", "")).coalesce(1).write.mode("overwrite").text(a.out)
        else:
            for r in fasta.toLocalIterator():
                print(r["fasta"], end="")
        return 0
    proteins, name = _proteins(e, a)
    if a.verb == "encode":
        _emit(sinks.encode_summary(proteins).withColumn("pair_index", F.col("input_id")), a.out)
        return 0
    if a.verb == "score-alignment":
        text = e.spark.read.text(a.correspondence, wholetext=True).select(F.col("value").alias("content"))
        given = tb.parse_correspondence(text).select(F.lit(0).cast("bigint").alias("pair_index"), F.lit(0).cast("bigint").alias("query_index"), F.lit(1).cast("bigint").alias("target_index"), "step", "q", "t")
        scored = e.score_alignment(proteins, given)
        if a.json:
            for r in sinks.score_json(scored).collect():
                print(r["json"])
        else:
            _emit(sinks.score_table(scored).withColumn("pair_index", F.lit(0)), a.out)
        return 0
    options = {"package_name": name, "mode": a.mode, "gap_open": a.gap_open, "gap_extension": a.gap_extension, "temperature": a.temperature}
    if a.verb == "all-vs-all":
        results = e.all_vs_all(proteins, include_self=a.include_self, **options)
    elif a.verb == "pair-list":
        results = e.pair_list(proteins, tb.read_pair_list(e.spark, a.pairs), **options)
    else:
        two = proteins.orderBy("idx").limit(3).collect()
        if len(two) != 2:
            raise InvalidArgument("pairwise wants two inputs")
        pairs = e.spark.createDataFrame([(0, two[0]["input_id"], two[1]["input_id"])], "pair_index long, query_id string, target_id string")
        results = e.pair_list(proteins, pairs, **options)
    results = results.persist()
    for w in {w for r in results.select("warnings").limit(1).collect() for w in r[0]}:
        print(f"warning: {w}", file=sys.stderr)
    if a.alignments:
        sinks.write_texts(sinks.alignment_fasta(results, proteins), "fasta", a.alignments)
    if a.pdb:
        sinks.write_texts(sinks.superposed_pdb(results, proteins), "pdb", a.pdb)
    _emit(sinks.summary(results, proteins, a.dual_score), a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return next((code for kind, code in EXIT_CODES.items() if isinstance(e, kind)), 5)


if __name__ == "__main__":
    sys.exit(main())
