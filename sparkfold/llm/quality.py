"""Quality rules: counts of each text, rule failures by host, and verdicts of hosts shrunk to a beta prior.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, let, lookup_join

#: Names of the rules whose failures are counted by host.
RULES = ("base_failed", "symbols_failed", "lines_failed", "letters_failed")


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbol_pct: int = 30
    max_dup_line_pct: int = 30
    max_mean_word: int = 15
    #: A host is rejected when its shrunk failure rate for any rule is above this.
    max_host_rate: float = 0.5


def _repeated(h: Column) -> Column:
    """Words in 5-word windows whose hash is in h more than once."""
    ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = let(ranked, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    new = let(places, lambda p: F.transform(p, lambda at, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - at, F.lit(5)))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x))


def _window_hashes(w: Column) -> Column:
    windows = F.slice(w, F.lit(1), F.size(w) - 4)
    return F.when(F.size(w) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(windows, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4))))


def text_stats(text: Column) -> Column:
    """Struct of the counts of one text; a null text counts as empty.

    n_words, word_chars, n_symbols, n_lines and n_dup_lines (lines with a word; those equal to an
    earlier one), n_repeat_words. Windows are compared by 64-bit hashes within the text.
    """
    t = F.coalesce(text, F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    words = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), let(_window_hashes(w), _repeated).alias("n_repeat_words")))
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.translate(x, blank, "") != ""), lambda v: F.struct(F.size(v).cast("bigint").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("n_dup_lines")))
    return F.struct(
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate(t, blank, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
    )


def with_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs with the counts and a boolean for each of RULES; columns of docs so named are replaced."""
    s = docs.withColumn("_stats", text_stats(F.col("text")))
    s = s.withColumns({"n_words": F.col("_stats.words.n_words"), "word_chars": F.col("_stats.word_chars"), "n_symbols": F.col("_stats.n_symbols"), "n_lines": F.col("_stats.lines.n_lines"), "n_dup_lines": F.col("_stats.lines.n_dup_lines"), "n_repeat_words": F.col("_stats.words.n_repeat_words")}).drop("_stats")
    n = F.col("n_words")
    return s.withColumns(
        {
            "base_failed": (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * n),
            "symbols_failed": 100 * F.col("n_symbols") > limits.max_symbol_pct * n,
            "lines_failed": 100 * F.col("n_dup_lines") > limits.max_dup_line_pct * F.col("n_lines"),
            "letters_failed": F.col("word_chars") > limits.max_mean_word * n,
        }
    )


def host_verdicts(ruled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """source, host_ok: one row for each host.

    Per rule, the failure rates of hosts give a beta prior by moments (mean m; strength s from
    the variance between hosts, weighted by documents, held to 1 .. 10000), and a host's shrunk rate
    is (failures + s m) / (documents + s). Documents without a source have no host and no verdict.
    """
    hosts = ruled.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("bigint")).alias(r) for r in RULES])
    n = F.col("n")
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES]).first()
    if not total["n"]:
        return hosts.select("source", F.lit(True).alias("host_ok"))
    mean = {r: total[r] / total["n"] for r in RULES}
    spread = hosts.agg(*[F.sum(n * (F.col(r) / n - mean[r]) ** 2).alias(r) for r in RULES]).first()
    bad = F.lit(False)
    for r in RULES:
        m, v = mean[r], spread[r] / total["n"]
        s = min(max(m * (1 - m) / v - 1, 1.0), 10_000.0) if v > 0 else 10_000.0
        bad = bad | ((F.col(r) + s * m) / (n + s) > limits.max_host_rate)
    return hosts.select("source", (~bad).alias("host_ok"))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each row of docs: doc_id, source, the counts, base_failed, host_ok and kept.

    kept = not base_failed and the host isn't rejected. Empty and null texts fail the base rule; rows
    with equal doc_ids are judged one by one; an empty table gives no rows.
    """
    ruled = cut(with_rules(docs.select("doc_id", "source", "text"), limits).drop("text"))
    out = lookup_join(ruled, host_verdicts(ruled, limits), ["source"], F.col("doc_id"))
    return out.withColumn("host_ok", F.coalesce("host_ok", F.lit(True))).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns; counts are made twice, texts never shuffled."""
    hosts = host_verdicts(with_rules(docs.select("source", "text"), limits), limits)
    rejected = cut(hosts.where(~F.col("host_ok")).select("source", F.lit(True).alias("_rejected")))
    # one expression, so that pushing it below other columns doesn't count a text's words more than once
    passed = let(text_stats(F.col("text"))["words"], lambda w: (w["n_words"] >= limits.min_words) & (100 * w["n_repeat_words"] <= limits.max_repeat_pct * w["n_words"]))
    good = docs.where(passed)
    return lookup_join(good, rejected, ["source"], F.col("doc_id")).where(F.col("_rejected").isNull()).select(docs.columns)
