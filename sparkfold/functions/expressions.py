"""Column expressions of the numeric and text primitives; all of them run inside Spark's own engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import AMBIGUOUS, AMBIGUOUS_TOKEN, AMINO, CB_B, CB_C, CB_CROSS, MODIFIED, OTHER_TOKEN, RESIDUES, START_TOKEN, STOP_TOKEN, UNKNOWN_CODE
from .geometry import RBF_COUNT, RBF_HIGH, RBF_LOW, RBF_SIGMA


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def row_mean(a: Column) -> Column:
    return total(a) / F.size(a)


def softmax(a: Column, temperature: float = 1.0, mask: Column | None = None) -> Column:
    """exp of a / temperature over their sum; masked items (mask 0) get 0, and a fully masked row gets zeros."""
    if mask is not None:
        a = F.zip_with(a, mask, lambda x, m: F.when(m != 0, x))
    e = F.transform(a, lambda x: F.coalesce(F.exp((x - F.array_max(a)) / temperature), F.lit(0.0)))
    return F.transform(F.array(e), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, total(v)), F.lit(0.0))))[0]


def log_softmax(a: Column) -> Column:
    z = F.array_max(a) + F.log(total(F.transform(a, lambda x: F.exp(x - F.array_max(a)))))
    return F.transform(F.array(z), lambda s: F.transform(a, lambda x: x - s))[0]


def layer_norm(a: Column, epsilon: float = 1e-5, scale: Column | None = None, shift: Column | None = None) -> Column:
    """(a - mean) / sqrt(population variance + epsilon), then scale and shift item by item."""
    moments = F.transform(F.array(row_mean(a)), lambda m: F.struct(m.alias("m"), row_mean(F.transform(a, lambda x: (x - m) * (x - m))).alias("v")))
    out = F.transform(moments, lambda s: F.transform(a, lambda x: (x - s["m"]) / F.sqrt(s["v"] + epsilon)))[0]
    if scale is not None:
        out = F.zip_with(out, scale, lambda x, g: x * g)
    if shift is not None:
        out = F.zip_with(out, shift, lambda x, g: x + g)
    return out


def erf(x: Column) -> Column:
    """The error function to 1.5e-7 (Abramowitz and Stegun 7.1.26; fixed values)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def axpy(a: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: a * p + q)


def argmax(a: Column) -> Column:
    """Position of the first largest item, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def rbf(distance: Column) -> Column:
    step = (RBF_HIGH - RBF_LOW) / (RBF_COUNT - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(RBF_COUNT - 1)), lambda k: F.when(distance < 0, F.lit(0.0)).otherwise(F.exp(-F.pow(distance - (F.lit(RBF_LOW) + k * step), F.lit(2.0)) / (2 * RBF_SIGMA**2))))


def positional_class(i: Column, j: Column, same_chain: Column | None = None) -> Column:
    near = F.greatest(F.lit(-32), F.least(F.lit(32), i - j)) + 32
    return near if same_chain is None else F.when(same_chain, near).otherwise(65)


def virtual_cb(n: Column, ca: Column, c: Column) -> Column:
    """CB of three arrays of x, y, z."""
    b = [ca[k] - n[k] for k in range(3)]
    e = [c[k] - ca[k] for k in range(3)]
    cross = [b[1] * e[2] - b[2] * e[1], b[2] * e[0] - b[0] * e[2], b[0] * e[1] - b[1] * e[0]]
    return F.array(*[ca[k] + CB_CROSS * cross[k] + CB_B * b[k] + CB_C * e[k] for k in range(3)])


def tm_d0(length: Column) -> Column:
    return F.greatest(F.lit(0.5), 1.24 * F.cbrt(F.greatest(length - 15, F.lit(1))) - 1.8)


def residue_letters(text: Column) -> Column:
    """Letters of a sequence with a-z raised; gaps, stops and blanks are dropped."""
    return F.translate(F.regexp_replace(text, r"[-*\s]", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def token(letter: Column) -> Column:
    at = F.instr(F.lit(AMINO), letter)
    return F.when(at > 0, at - 1).when(F.instr(F.lit(AMBIGUOUS), letter) > 0, AMBIGUOUS_TOKEN).otherwise(OTHER_TOKEN)


def tokenize(text: Column) -> Column:
    """Tokens of a sequence's letters; an empty sequence has none."""
    letters = residue_letters(text)
    return F.when(letters == "", F.array().cast("array<int>")).otherwise(F.transform(F.regexp_extract_all(letters, F.lit("(?s)."), F.lit(0)), token).cast("array<int>"))


def wrap_tokens(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(START_TOKEN)), tokens, F.array(F.lit(STOP_TOKEN)))


def unwrap_rows(rows: Column) -> Column:
    """Rows without those of the start and stop tokens."""
    return F.slice(rows, F.lit(2), F.size(rows) - 2)


def residue_code(name: Column) -> Column:
    key = F.upper(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in (RESIDUES | MODIFIED).items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(UNKNOWN_CODE))


def sanitize(text: Column) -> Column:
    """Runs of other characters than letters, digits, `_`, `.`, `-`, and of `_`, become one `_`."""
    return F.regexp_replace(text, r"[^A-Za-z0-9.\-]+", "_")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def artifact_name(index: Column, path: Column, chain: Column, model: Column) -> Column:
    """A stable name: 4-digit number from 1, stem, chain (A if none), model."""
    named = F.when(F.coalesce(F.trim(chain), F.lit("")) == "", F.lit("A")).otherwise(chain)
    return sanitize(F.concat(F.lpad((index + 1).cast("string"), 4, "0"), F.lit("_"), stem(path), F.lit("_"), named, F.lit("_model"), model.cast("string")))


def wrap_lines(text: Column, width: int = 80) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), "\n$", "")


def gapped(codes: Column, indices: Column) -> Column:
    """Letters at the indices, `-` at -1."""
    return F.array_join(F.transform(indices, lambda i: F.when(i < 0, F.lit("-")).otherwise(F.substring(codes, i + 1, F.lit(1)))), "")


def length_normalised(raw: Column, aligned: Column, lq: Column, lt: Column) -> list[Column]:
    """sw_per_query_len, sw_per_target_len, sw_per_aligned; null where nothing is aligned."""
    full = aligned > 0
    return [F.when(full, raw / lq).alias("sw_per_query_len"), F.when(full, raw / lt).alias("sw_per_target_len"), F.when(full, raw / aligned).alias("sw_per_aligned")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _add64(a: Column, b: Column) -> Column:
    """a + b that wraps, from 32-bit halves."""
    low = _low32(a) + _low32(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_low32(high), 32).bitwiseOR(_low32(low))


def _times64(x: Column, k: int) -> Column:
    """x * k that wraps, from 16-bit pieces of k, so that no product overflows."""
    out = None
    for piece in range(4):
        part = (k >> (16 * piece)) & 0xFFFF
        low, high = _low32(x) * part, F.shiftrightunsigned(x, 32) * part
        product = _add64(low, F.shiftleft(_low32(high), 32))
        product = F.shiftleft(product, 16 * piece) if piece else product
        out = product if out is None else _add64(out, product)
    return out


def splitmix64(state: Column) -> Column:
    """Output of a splitmix64 generator for a 64-bit state (fixed values: its published constants)."""
    z = F.transform(F.array(state), lambda s: _add64(s, F.lit(_signed(0x9E3779B97F4A7C15))))
    z = F.transform(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)))
    z = F.transform(z, lambda v: _times64(v, 0xBF58476D1CE4E5B9))
    z = F.transform(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)))
    z = F.transform(z, lambda v: _times64(v, 0x94D049BB133111EB))
    return F.transform(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))[0]


def uniform(bits: Column) -> Column:
    """[0, 1) from the upper 53 bits."""
    return F.shiftrightunsigned(bits, 11).cast("double") / float(1 << 53)
