"""Schemas, model packages and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Amino-acid letters by token, other letters' tokens, and special tokens.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS_TOKEN, OTHER_TOKEN, START_TOKEN, STOP_TOKEN = 19, 24, 26, 27
AMBIGUOUS = "BUZOX"
DESIGN_ALPHABET = AMINO + "X"

#: Three-letter codes of the twenty residues and of the modified ones read as their parents.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
MODIFIED = {"MSE": "M", "SEC": "C", "PYL": "K", "SEP": "S", "TPO": "T", "PTR": "Y", "HYP": "P"}
UNKNOWN_CODE = "X"

ATOMS = ("N", "CA", "C", "O", "CB")
MISSING, OBSERVED, INFERRED, VIRTUAL = 0, 1, 2, 3
GAP = -1

#: Glycine CB from N, CA, C: coefficients of b x c, b = CA - N, c = C - CA.
CB_CROSS, CB_B, CB_C = -0.58273431, 0.56802827, -0.54067466

ATOM_SCHEMA = "input_id string, source_index long, record long, model int, chain string, resnum int, icode string, resname string, atom string, altloc string, x double, y double, z double, occupancy double, element string, hetatm boolean, serial int"
RESIDUE_SCHEMA = "input_id string, source_index long, residue_index int, code string, resname string, chain string, model int, resnum int, icode string, xyz array<double>, source array<int>, break_after boolean"
PROTEIN_SCHEMA = "idx long, input_id string, length int, dim int, embedding array<float>, codes string, ca array<double>, ca_source array<int>"
STEP = "struct<query_index:int,target_index:int,residue_score:double>"
PATH = f"struct<steps:array<{STEP}>,aligned_pairs:int,query_start:int,query_end:int,target_start:int,target_end:int>"
ALIGNMENT_SCHEMA = f"pair_index long, query_index long, target_index long, raw_sw_score double, soft_sw_score double, path {PATH}"

METRICS = (
    "coverage_query", "coverage_target", "coverage_mean", "identity", "rmsd", "tm_score_query", "tm_score_target",
    "lddt", "lddt_byA", "lddt_byB", "lddt_aln", "coverage_byA", "coverage_byB", "ecs",
)
SUMMARY_COLUMNS = ("query_index", "target_index", "pair_id", "raw_sw_score", "aligned_pairs", *METRICS, "fasta_path", "pdb_path")
DUAL_COLUMNS = ("soft_sw_score", "sw_per_query_len", "sw_per_target_len", "sw_per_aligned")


class EngineError(Exception):
    """Any failure of a request."""


class InvalidArgument(EngineError, ValueError):
    pass


class NotFound(EngineError, LookupError):
    pass


class FailedPrecondition(EngineError, RuntimeError):
    pass


class Unimplemented(EngineError, NotImplementedError):
    pass


class DataFormatError(InvalidArgument):
    pass


#: Exit codes of the command line.
EXIT_CODES = {InvalidArgument: 2, DataFormatError: 2, NotFound: 2, FailedPrecondition: 3, Unimplemented: 4}


@dataclass(frozen=True)
class Gaps:
    open: float
    extension: float


@dataclass(frozen=True)
class Package:
    """A scoring model: what it embeds, at which width, and its calibrated gaps."""

    name: str
    kind: str
    dim: int
    hard: Gaps
    soft: Gaps
    aliases: tuple[str, ...] = ()
    temperature: float = 1.0
    capabilities: frozenset[str] = field(default_factory=frozenset)


#: Calibrated gaps are fixed values; the sequence model's hard extension is positive on purpose.
PACKAGES = {
    p.name: p
    for p in (
        Package("structure-d64", "structure", 64, Gaps(-1.4, -0.15), Gaps(-3.21337, -0.111704), ("structure", "mpnn", "default"), capabilities=frozenset({"encode", "align", "soft"})),
        Package("sequence-320", "sequence", 320, Gaps(-1.01982, 0.225736), Gaps(-6.72805, -0.0159468), ("sequence", "esm2"), capabilities=frozenset({"encode", "align", "soft"})),
        Package("design-128", "design", 128, Gaps(0.0, 0.0), Gaps(0.0, 0.0), ("design", "inverse-fold"), capabilities=frozenset({"design"})),
    )
}


def package(name: str | Package) -> Package:
    if isinstance(name, Package):
        return name
    for p in PACKAGES.values():
        if name == p.name or name in p.aliases:
            return p
    raise NotFound(f"no package {name!r}; known: {', '.join(PACKAGES)}")


def resolve_gaps(pkg: Package, mode: str, gap_open: float | None = None, gap_extension: float | None = None) -> tuple[Gaps, list[str]]:
    """The gaps of a mode, with finite overrides in place of the package's, and warnings about those."""
    import math

    base = pkg.soft if mode == "soft" else pkg.hard
    picked, warnings = [], []
    for label, given, own in (("gap_open", gap_open, base.open), ("gap_extension", gap_extension, base.extension)):
        if given is None or math.isnan(given):
            picked.append(own)
            continue
        if math.isinf(given):
            raise InvalidArgument(f"{label} must be finite")
        if given != own:
            warnings.append(f"{label} {given:g} differs from the calibrated {own:g} of {pkg.name}")
        picked.append(float(given))
    return Gaps(*picked), warnings


def validate_package(p: Package) -> list[str]:
    """What is wrong with a package; empty if nothing is."""
    import math

    wrong = []
    if not p.name:
        wrong.append("no name")
    if p.kind not in ("structure", "sequence", "design"):
        wrong.append(f"unknown kind {p.kind!r}")
    if p.dim <= 0:
        wrong.append("width must be positive")
    if not all(map(math.isfinite, (p.hard.open, p.hard.extension, p.soft.open, p.soft.extension))):
        wrong.append("gaps must be finite")
    if not (p.temperature > 0 and math.isfinite(p.temperature)):
        wrong.append("temperature must be positive and finite")
    if p.kind != "design" and not {"encode", "align"} <= p.capabilities:
        wrong.append("a scoring package must encode and align")
    return wrong
