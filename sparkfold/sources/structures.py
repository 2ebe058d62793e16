"""Reading structure files into atoms, and atoms into residues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import residue_code
from ..functions.geometry import infer_atoms
from ..functions.lazy import pandas_udf
from ..model import ATOM_SCHEMA, ATOMS, MISSING, MODIFIED, OBSERVED, RESIDUES, DataFormatError, InvalidArgument, NotFound

SUFFIXES = ("pdb", "ent", "cif", "mmcif")


def file_format(path: Column, content: Column) -> Column:
    """`mmcif`, `pdb` or null: by suffix, else by what the text begins with or holds."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.(cif|mmcif)$"), "mmcif").when(p.rlike(r"\.(pdb|ent)$"), "pdb")
        .when(content.rlike(r"(?m)^\s*data_") | (F.instr(content, "_atom_site.") > 0), "mmcif")
        .when(content.rlike(r"(?m)^(HEADER|MODEL |ATOM  |HETATM|REMARK|TITLE |CRYST1)"), "pdb")
    )


def structure_files(spark: SparkSession, directory: str, ids: DataFrame | None = None) -> DataFrame:
    """input_id (the stem), source_index (place among the sorted paths), path, content of the structure files of a directory.

    With ids (column input_id) only those files are opened; their places stay those of the whole directory, whose
    listing the driver holds in any case. Suffixes are known in any case of letters. An empty directory is an error.
    """
    anyhow = ",".join("".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in SUFFIXES)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + anyhow + "}").load(directory)
    paths = listed.select("path")
    if not paths.limit(1).count():
        raise InvalidArgument(f"{directory} holds no structure files")
    # one row a file: the listing is small beside what the files hold
    named = paths.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint").alias("source_index"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("input_id"))
    if ids is not None:
        named = named.join(ids.select("input_id").distinct(), "input_id", "left_semi")
        wanted = named.collect()
        named = spark.createDataFrame(wanted, named.schema)
        if not wanted:
            return named.withColumn("content", F.lit(None).cast("string"))
        listed = spark.read.format("binaryFile").load([r["path"] for r in wanted])
    return named.join(listed.select("path", F.decode("content", "UTF-8").alias("content")), "path")


def parse_pdb(files: DataFrame) -> DataFrame:
    """Atoms of PDB texts (input_id, source_index, content), by fixed columns; malformed numbers are errors.

    The model of a record is that of the last MODEL line with a number before it, 1 if there is none. A text is cut at
    its MODEL lines within its own row, so lines aren't shuffled.
    """
    number_of = lambda part: F.trim(F.substring(F.split(part, r"\r?\n")[0], 7, 20)).try_cast("int")
    parts = F.transform(F.split("content", "(?m)^(?=MODEL )"), lambda part: F.struct(part.alias("text"), F.when(part.startswith("MODEL "), number_of(part)).alias("model"), (F.length(part) - F.length(F.translate(part, "\n", ""))).alias("lines")))
    cut = files.select("input_id", "source_index", parts.alias("parts")).select("input_id", "source_index", "parts", F.posexplode("parts").alias("k", "part"))
    before = F.slice("parts", F.lit(1), F.col("k"))
    told = F.filter(F.slice("parts", F.lit(1), F.col("k") + 1), lambda part: part["model"].isNotNull())
    cut = cut.select("input_id", "source_index", "part.text", F.coalesce(F.get(told, F.size(told) - 1)["model"], F.lit(1)).alias("model"), F.aggregate(before, F.lit(0), lambda n, part: n + part["lines"]).alias("first"))
    lines = cut.select("input_id", "source_index", "model", "first", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("record", F.col("first") + F.col("at"))
    keep = F.substring("line", 1, 6).isin("ATOM  ", "HETATM")
    seen = lines.where(keep)
    text = lambda a, n: F.trim(F.substring("line", a + 1, n))

    def number(a: int, n: int, kind: str, what: str) -> Column:
        v = text(a, n).try_cast(kind)
        return F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"bad {what} in "), "input_id", F.lit(", line "), (F.col("record") + 1).cast("string")))).otherwise(v)

    a = seen
    short = F.when(F.length("line") < 54, F.raise_error(F.concat(F.lit("short atom record in "), "input_id")))
    return a.select(
        "input_id", "source_index", F.col("record").cast("bigint").alias("record"), "model", F.coalesce(short, text(21, 1)).cast("string").alias("chain"),
        number(22, 4, "int", "residue number").alias("resnum"), text(26, 1).alias("icode"), text(17, 3).alias("resname"), text(12, 4).alias("atom"), text(16, 1).alias("altloc"),
        *[number(30 + 8 * k, 8, "double", f"{c} coordinate").alias(c) for k, c in enumerate("xyz")],
        text(54, 6).try_cast("double").alias("occupancy"), text(76, 2).alias("element"), F.col("line").startswith("HETATM").alias("hetatm"), number(6, 5, "int", "serial").alias("serial"),
    )


_TOKEN = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\S+)""")


def cif_atoms(text: str, name: str) -> list[tuple]:
    """Rows of the _atom_site loop: record, model, chain, resnum, icode, resname, atom, altloc, xyz, occupancy, element, hetatm, serial."""

    def tokens() -> Iterator[tuple[str, bool]]:
        lines = iter(text.splitlines())
        for line in lines:
            if line.startswith(";"):
                part = [line[1:]]
                for more in lines:
                    if more.startswith(";"):
                        break
                    part.append(more)
                yield "\n".join(part), True
                continue
            for m in _TOKEN.finditer(line):
                if m[3] is not None and m[3].startswith("#"):
                    break
                yield next(g for g in m.groups() if g is not None), m[3] is None

    names: list[str] = []
    rows: list[list[str]] = []
    values: list[str] = []
    state = ""
    for tok, quoted in tokens():
        plain = not quoted
        if plain and tok.lower() == "loop_":
            if rows or values:
                break
            state, names = "head", []
        elif state == "head" and plain and tok.startswith("_"):
            names.append(tok)
        elif state in ("head", "body") and names and names[0].startswith("_atom_site."):
            if plain and (tok.startswith("_") or tok.lower().startswith("data_")):
                break
            state = "body"
            values.append(tok)
            if len(values) == len(names):
                rows.append(values)
                values = []
        elif state == "head":
            state = ""
    if not rows:
        raise DataFormatError(f"{name} has no _atom_site loop")
    if values:
        raise DataFormatError(f"{name}: the last atom record is cut off")
    at = {n.split(".", 1)[1]: k for k, n in enumerate(names)}
    for c in ("Cartn_x", "Cartn_y", "Cartn_z"):
        if c not in at:
            raise DataFormatError(f"{name} has no {c}")

    def get(r: list[str], *keys: str) -> str:
        for k in keys:
            if k in at and r[at[k]] not in (".", "?"):
                return r[at[k]]
        return ""

    out = []
    for k, r in enumerate(rows):
        try:
            out.append((
                k, int(get(r, "pdbx_PDB_model_num") or 1), get(r, "auth_asym_id", "label_asym_id"), int(get(r, "auth_seq_id", "label_seq_id")), get(r, "pdbx_PDB_ins_code"),
                get(r, "auth_comp_id", "label_comp_id"), get(r, "label_atom_id", "auth_atom_id"), get(r, "label_alt_id"), *(float(r[at[f"Cartn_{c}"]]) for c in "xyz"),
                float(get(r, "occupancy") or 1), get(r, "type_symbol"), get(r, "group_PDB") == "HETATM", int(get(r, "id") or 0),
            ))
        except ValueError as e:
            raise DataFormatError(f"{name}, atom record {k + 1}: {e}") from None
    return out


def parse_mmcif(files: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in ATOM_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame([(r.input_id, r.source_index, *a) for a in cif_atoms(r.content, r.input_id)], columns=names)

    return files.select("input_id", "source_index", "content").mapInPandas(run, ATOM_SCHEMA)


def read_atoms(files: DataFrame) -> DataFrame:
    """Atoms of files of either format; a file of neither is an error."""
    kind = file_format(F.coalesce(F.col("path"), F.lit("")), F.col("content"))
    known = files.withColumn("kind", F.coalesce(kind, F.raise_error(F.concat(F.lit("not a structure file: "), "path"))))
    return parse_pdb(known.where("kind = 'pdb'")).unionByName(parse_mmcif(known.where("kind = 'mmcif'")))


def polymer_atoms(atoms: DataFrame, modified_residues: bool = True) -> DataFrame:
    """The five backbone atoms of polymer residues: ATOM records, and HETATM ones of known modified residues."""
    known = F.upper(F.trim("resname")).isin(*MODIFIED)
    return atoms.where(F.col("atom").isin(*ATOMS) & (~F.col("hetatm") | (known & F.lit(modified_residues))))


def select_chain(atoms: DataFrame, model: int | None = None, chain: str | None = None) -> DataFrame:
    """One model and chain of each input: the named ones, else model 1, and chain A if there is one, else the first seen."""
    wanted_model = 1 if model is None else model
    own = Window.partitionBy("input_id", "source_index")
    atoms = atoms.where(F.col("model") == wanted_model)
    if chain is not None:
        return atoms.where(F.col("chain") == chain)
    has_a = F.max((F.col("chain") == "A").cast("int")).over(own)
    first = F.min_by("chain", "record").over(own)
    return atoms.withColumn("_pick", F.when(has_a == 1, F.lit("A")).otherwise(first)).where(F.col("chain") == F.col("_pick")).drop("_pick")


def best_altloc(atoms: DataFrame) -> DataFrame:
    """One atom of each name in a residue: blank alternates first, then A or a, then the first seen."""
    rank = F.when(F.coalesce("altloc", F.lit("")) == "", 0).when(F.upper("altloc") == "A", 1).otherwise(2)
    key = ["input_id", "source_index", "model", "chain", "resnum", "icode", "atom"]
    rest = [c for c in atoms.columns if c not in key]
    return atoms.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(rank, "record")).alias("v")).select(*key, "v.*")


def residues(atoms: DataFrame, infer: bool = True, modified_residues: bool = True, model: int | None = None, chain: str | None = None) -> DataFrame:
    """Residues of one chain of each input, in order of their first record: see RESIDUE_SCHEMA.

    xyz holds the five atoms (zeros where missing), source what each is: missing, observed, inferred or virtual.
    Inputs without a residue left have no rows; check_residues tells them.
    """
    one = best_altloc(select_chain(polymer_atoms(atoms, modified_residues), model, chain))
    key = ["input_id", "source_index", "model", "chain", "resnum", "icode"]
    spots = F.map_from_entries(F.collect_list(F.struct("atom", F.array("x", "y", "z"))))
    r = one.groupBy(*key).agg(F.min("record").alias("record"), F.min_by("resname", "record").alias("resname"), spots.alias("m"))
    own = Window.partitionBy("input_id", "source_index").orderBy("record")
    zeros = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    r = r.withColumns(
        {
            "residue_index": (F.row_number().over(own) - 1).cast("int"),
            "code": residue_code(F.col("resname")),
            "xyz": F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(a)), zeros) for a in ATOMS])),
            "source": F.array(*[F.when(F.array_contains(F.map_keys("m"), a), OBSERVED).otherwise(MISSING) for a in ATOMS]),
            "next_num": F.lead("resnum").over(own), "next_icode": F.lead("icode").over(own),
        }
    )
    jump = F.col("next_num") - F.col("resnum")
    gap = (jump > 1) | ((jump == 0) & (F.col("icode") != "") & (F.col("next_icode") == ""))
    out = r.select("input_id", "source_index", "residue_index", "code", "resname", "chain", "model", "resnum", "icode", "xyz", "source", F.coalesce(gap, F.lit(False)).alias("break_after"))
    return with_inferred(out) if infer else out


@pandas_udf("struct<xyz:array<double>,source:array<int>>")
def _filled(xyz: pd.Series, source: pd.Series, code: pd.Series) -> pd.DataFrame:
    rows = [infer_atoms(np.asarray(x, float).reshape(5, 3), np.asarray(s, int), c) for x, s, c in zip(xyz, source, code, strict=True)]
    return pd.DataFrame({"xyz": [x.ravel().tolist() for x, _ in rows], "source": [s.tolist() for _, s in rows]})


def with_inferred(r: DataFrame) -> DataFrame:
    """Missing atoms filled where a template fits; complete residues never leave the engine."""
    whole = ~F.array_contains("source", MISSING)
    filled = r.where(~whole).withColumn("f", _filled("xyz", "source", "code")).withColumns({"xyz": F.col("f.xyz"), "source": F.col("f.source")}).drop("f")
    return r.where(whole).unionByName(filled)


def check_residues(files: DataFrame, r: DataFrame) -> None:
    """An error for the first input, in order, that has no residue of the wanted model and chain."""
    lost = files.select("input_id", "source_index").join(r.select("source_index").distinct(), "source_index", "left_anti").orderBy("source_index").limit(1).collect()
    if lost:
        raise NotFound(f"{lost[0]['input_id']}: no residues of that model and chain")


def structure_proteins(r: DataFrame) -> DataFrame:
    """idx, input_id, length, codes, ca (flat), ca_source of each input; idx is its place among the inputs."""
    packed = r.groupBy("input_id", "source_index").agg(F.sort_array(F.collect_list(F.struct("residue_index", "code", "xyz", "source", "chain", "model"))).alias("v"))
    return packed.select(
        F.col("source_index").alias("idx"), "input_id", F.size("v").alias("length"), F.array_join("v.code", "").alias("codes"),
        F.flatten(F.transform("v.xyz", lambda x: F.slice(x, 4, 3))).alias("ca"), F.transform("v.source", lambda s: s[1]).alias("ca_source"),
        F.flatten("v.xyz").alias("xyz"), F.flatten("v.source").alias("sources"), F.get("v", F.lit(0))["chain"].alias("chain"), F.get("v", F.lit(0))["model"].alias("model"),
    )


STANDARD = tuple(RESIDUES)
