"""Forming pairs of proteins: lists of names, all against all, tiles, and orders of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import InvalidArgument, NotFound

#: Proteins of a tile; a tile pair is one unit of work, to which each of its proteins is sent once.
TILE = 64
#: Alignment cells of a pair of tiles at most.
TILE_CELLS = 1 << 28


def plan_sizes(proteins: DataFrame) -> dict[str, int]:
    """Planning reductions over proteins (length): n, the longest, all residues, and the most steps that a path of two can have."""
    r = proteins.agg(F.count("*").alias("n"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"), F.coalesce(F.sum("length"), F.lit(0)).alias("residues")).first()
    return {"n": int(r["n"]), "longest": int(r["longest"]), "residues": int(r["residues"]), "most_steps": 2 * int(r["longest"])}


def tile_size(sizes: dict[str, int], cores: int, most_cells: int = TILE_CELLS) -> int:
    """Proteins of a tile: so few that there are tile pairs for all cores and that a pair of tiles has most_cells at most, TILE at most."""
    tiles = 1
    while tiles * (tiles + 1) // 2 < 2 * cores:
        tiles += 1
    spread = -(-sizes["n"] // tiles)
    fits = int((most_cells / max(sizes["longest"], 1) ** 2) ** 0.5)
    return max(1, min(TILE, spread, fits))


def pair_count(n: int, include_self: bool = False) -> int:
    return n * (n + 1) // 2 if include_self else n * (n - 1) // 2


def linear_index(i: Column, j: Column, n: int | Column, include_self: bool = False) -> Column:
    """Place of (i, j) among the pairs i < j (or i <= j) in row order."""
    n = F.lit(n) if isinstance(n, int) else n
    own = F.lit(1 if include_self else 0)
    before = F.floor(i * (2 * n - i - 1 + 2 * own) / 2)  # pairs of the rows above
    return (before + j - i - 1 + own).cast("bigint")


def decode_index(k: Column, n: int, include_self: bool = False) -> tuple[Column, Column]:
    """(i, j) of a place: the row by the quadratic formula, put right by whole numbers."""
    own = 1 if include_self else 0
    width = 2 * n - 1 + 2 * own
    guess = F.floor((F.lit(float(width)) - F.sqrt(F.lit(float(width) ** 2) - 8.0 * k)) / 2).cast("bigint")
    start = lambda r: F.floor(r * (width - r) / 2).cast("bigint")
    row = F.when(start(guess) > k, guess - 1).when(start(guess + 1) <= k, guess + 1).otherwise(guess)
    row = F.greatest(F.least(row, F.lit(n - 1)), F.lit(0)).cast("bigint")
    return row, (k - start(row) + row + 1 - own).cast("bigint")


def all_pairs(proteins: DataFrame, include_self: bool = False, tile: int = TILE) -> DataFrame:
    """pair_index, query_index, target_index of all pairs i < j (or i <= j) of proteins.idx, which runs from 0.

    Proteins meet by an equi-join on tiles: each is copied once for each tile of partners, and no
    nested loop over all rows is planned.
    """
    n = proteins.count()
    tiles = max(1, -(-n // tile))
    ids = proteins.select(F.col("idx").cast("bigint").alias("idx"), F.floor(F.col("idx") / tile).cast("int").alias("own"))
    left = ids.select(F.col("idx").alias("query_index"), F.col("own").alias("ti"), F.explode(F.sequence(F.col("own"), F.lit(tiles - 1))).alias("tj"))
    right = ids.select(F.col("idx").alias("target_index"), F.col("own").alias("tj"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("ti"))
    ahead = F.col("query_index") <= F.col("target_index") if include_self else F.col("query_index") < F.col("target_index")
    pairs = left.join(right, ["ti", "tj"]).where(ahead)
    return pairs.select(linear_index(F.col("query_index"), F.col("target_index"), n, include_self).alias("pair_index"), "query_index", "target_index")


def tile_members(proteins: DataFrame, tile: int = TILE) -> DataFrame:
    """ti, tj, side and the columns of proteins: the members of each pair of tiles ti <= tj, each protein once a tile pair."""
    tiles = max(1, -(-proteins.count() // tile))
    own = F.floor(F.col("idx") / tile).cast("int")
    each = proteins.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return each.withColumns({"ti": F.least("own", "with"), "tj": F.greatest("own", "with"), "side": (F.col("own") > F.col("with")).cast("int")}).drop("own", "with")


def ranges(count: int, parts: int) -> list[tuple[int, int]]:
    """Contiguous ranges of pair places of nearly equal size."""
    size, more = divmod(count, max(parts, 1))
    out, at = [], 0
    for k in range(max(parts, 1)):
        end = at + size + (k < more)
        out.append((at, end))
        at = end
    return out


def resolve_pairs(pairs: DataFrame, proteins: DataFrame, check: bool = True) -> DataFrame:
    """pair_index, query_id, target_id, query_index, target_index in the caller's order; duplicate, reverse and self pairs stay.

    Unknown ids, and ids that several proteins have, are errors if a pair names them (one small action);
    the first bad pair in order is told. Proteins that no pair names don't matter.
    """
    ids = proteins.where(F.col("input_id") != "").groupBy("input_id").agg(F.min("idx").alias("idx"), F.count("*").alias("n"))
    named = pairs.select(F.col("pair_index").cast("bigint").alias("pair_index"), "query_id", "target_id")
    out = named
    for side in ("query", "target"):
        out = out.join(ids.select(F.col("input_id").alias(f"{side}_id"), F.col("idx").cast("bigint").alias(f"{side}_index"), F.col("n").alias(f"{side}_n")), f"{side}_id", "left")
    if check:
        bad = out.where("query_n IS NULL OR query_n > 1 OR target_n IS NULL OR target_n > 1").orderBy("pair_index").limit(1).collect()
        if bad:
            r = bad[0]
            side = "query" if r["query_n"] != 1 else "target"
            if r[f"{side}_n"] is None:
                raise NotFound(f"pair {r['pair_index']}: no input is named {r[f'{side}_id']!r}")
            raise InvalidArgument(f"pair {r['pair_index']}: several inputs are named {r[f'{side}_id']!r}")
    return out.where("query_n = 1 AND target_n = 1").select("pair_index", "query_id", "target_id", "query_index", "target_index")


def referenced(pairs: DataFrame, proteins: DataFrame) -> DataFrame:
    """The proteins that some pair names; each is encoded once, however many pairs name it."""
    ids = pairs.select(F.col("query_id").alias("input_id")).union(pairs.select("target_id")).distinct()
    return proteins.join(ids, "input_id", "left_semi")


def missing_ids(pairs: DataFrame, proteins: DataFrame) -> DataFrame:
    ids = pairs.select(F.col("query_id").alias("input_id")).union(pairs.select("target_id")).distinct()
    return ids.join(proteins, "input_id", "left_anti")


def ambiguous_ids(pairs: DataFrame, proteins: DataFrame) -> DataFrame:
    many = proteins.groupBy("input_id").agg(F.count("*").alias("n")).where("n > 1")
    ids = pairs.select(F.col("query_id").alias("input_id")).union(pairs.select("target_id")).distinct()
    return many.join(ids, "input_id", "left_semi")


def pair_cost(lq: Column, lt: Column) -> Column:
    """Cells of the alignment, held to the largest 64-bit number."""
    return F.least(lq.cast("decimal(38,0)") * lt.cast("decimal(19,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
