"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_AA = "ACDEFGHIKLMNPQRSTVWY"

#: Residues, proteins as lists, and pairs; `k` is a residue's place.
BASE = f"""
r AS MATERIALIZED (
  SELECT label::BIGINT AS idx, 'p' || label AS input_id, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS k,
         list_transform(embedding, lambda x: x::DOUBLE) AS e, substr('{_AA}', (vec_id % 20 + 1)::INT, 1) AS code, vec_id % 17 <> 0 AS observed,
         10 * embedding[1]::DOUBLE AS x, 10 * embedding[2]::DOUBLE AS y, 10 * embedding[3]::DOUBLE AS z
  FROM embeddings WHERE label IS NOT NULL
), p AS MATERIALIZED (
  SELECT idx, any_value(input_id) AS input_id, count(*)::INT AS n, list(e ORDER BY k) AS es, string_agg(code, '' ORDER BY k) AS codes FROM r GROUP BY idx
), np AS (SELECT count(*)::BIGINT AS n FROM p)
"""


def _index(own: int) -> str:
    return f"(a.idx * (2 * (SELECT n FROM np) - a.idx - 1 + {2 * own}) // 2 + b.idx - a.idx - 1 + {own})::BIGINT"


def _pairs(own: int = 0, listed: bool = False) -> str:
    cols = "a.idx AS q, b.idx AS t, a.n AS lq, b.n AS lt, list_transform(a.es, lambda v: list_transform(b.es, lambda w: list_inner_product(v, w))) AS s"
    if listed:
        return f"""pairs AS MATERIALIZED (
  SELECT l.pair_index, {cols} FROM (VALUES (0::BIGINT, 'p0', 'p1'), (1, 'p3', 'p0'), (2, 'p0', 'p1'), (3, 'p2', 'p2'), (4, 'p1', 'p0')) l(pair_index, qi, ti)
  JOIN p a ON a.input_id = l.qi JOIN p b ON b.input_id = l.ti)"""
    return f"pairs AS MATERIALIZED (SELECT {_index(own)} AS pair_index, {cols} FROM p a JOIN p b ON a.idx {'<=' if own else '<'} b.idx)"


def _hard(go: float, ge: float, own: int = 0, listed: bool = False) -> str:
    """CTEs up to `hard` (pair_index, q, t, lq, lt, best, bi, bj, tr) by anti-diagonals; list slot i + 1 is row i."""
    return f"""
WITH RECURSIVE {BASE}, {_pairs(own, listed)},
sw AS (
  SELECT pair_index, 1 AS d, lq, lt, s, list_transform(range(lq + 1), lambda i: CASE WHEN i <= 1 THEN 0.0::DOUBLE ELSE -1e300 END) AS m1,
         list_transform(range(lq + 1), lambda i: -1e300::DOUBLE) AS i1, list_transform(range(lq + 1), lambda i: -1e300::DOUBLE) AS d1,
         list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE -1e300 END) AS m2,
         list_transform(range(lq + 1), lambda i: -1e300::DOUBLE) AS i2, list_transform(range(lq + 1), lambda i: -1e300::DOUBLE) AS d2,
         0.0::DOUBLE AS best, -1::BIGINT AS bi, -1::BIGINT AS bj, [list_transform(range(lq + 1), lambda i: 0::BIGINT)] AS tr
  FROM pairs
  UNION ALL
  SELECT pair_index, d, lq, lt, s, m, ins, del, m1, i1, d1, greatest(best, top), CASE WHEN top > best OR (top = best AND top > 0 AND row < bi) THEN row ELSE bi END,
         CASE WHEN top > best OR (top = best AND top > 0 AND row < bi) THEN d - row ELSE bj END, list_append(tr, code)
  FROM (
    SELECT *, coalesce(list_max(list_transform(range(greatest(1, d - lt), least(lq, d - 1) + 1), lambda i: m[i + 1])), -1e300) AS top,
           greatest(1, d - lt) - 1 + list_position(list_transform(range(greatest(1, d - lt), least(lq, d - 1) + 1), lambda i: m[i + 1]), list_max(list_transform(range(greatest(1, d - lt), least(lq, d - 1) + 1), lambda i: m[i + 1]))) AS row
    FROM (
      SELECT pair_index, d + 1 AS d, lq, lt, s, m1, i1, d1, best, bi, bj, tr,
        list_transform(range(lq + 1), lambda i: CASE WHEN d + 1 - i < 0 OR d + 1 - i > lt THEN -1e300 WHEN i = 0 OR d + 1 - i = 0 THEN 0.0 ELSE s[i][d + 1 - i] + greatest(0.0, m2[i], i2[i], d2[i]) END) AS m,
        list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > lt THEN -1e300 ELSE greatest(m1[i] + {go}, i1[i] + {ge}) END) AS ins,
        list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > lt THEN -1e300 ELSE greatest(m1[i + 1] + {go}, d1[i + 1] + {ge}) END) AS del,
        list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > lt THEN 0 ELSE
          CASE WHEN greatest(0.0, m2[i], i2[i], d2[i]) = 0 THEN 0 WHEN greatest(m2[i], i2[i], d2[i]) = m2[i] THEN 1 WHEN greatest(i2[i], d2[i]) = i2[i] THEN 2 ELSE 3 END
          + CASE WHEN i1[i] + {ge} > m1[i] + {go} THEN 4 ELSE 0 END + CASE WHEN d1[i + 1] + {ge} > m1[i + 1] + {go} THEN 8 ELSE 0 END END) AS code
      FROM sw WHERE d < lq + lt
    )
  )
),
hard AS MATERIALIZED (SELECT w.pair_index, q, t, w.lq, w.lt, best, bi, bj, tr, w.s FROM sw w JOIN pairs USING (pair_index) WHERE d = w.lq + w.lt)"""


_WALK = """,
walk AS (
  SELECT pair_index, 0 AS n, bi AS i, bj AS j, 1 AS st, s, tr FROM hard WHERE best > 0
  UNION ALL
  SELECT pair_index, n + 1, CASE WHEN st IN (1, 2) THEN i - 1 ELSE i END, CASE WHEN st IN (1, 3) THEN j - 1 ELSE j END,
         CASE st WHEN 1 THEN c & 3 WHEN 2 THEN CASE WHEN c & 4 > 0 THEN 2 ELSE 1 END ELSE CASE WHEN c & 8 > 0 THEN 3 ELSE 1 END END, s, tr
  FROM (SELECT *, tr[i + j][i + 1] AS c FROM walk WHERE st > 0 AND i > 0 AND j > 0)
),
steps AS MATERIALIZED (
  SELECT pair_index, (max(n) OVER (PARTITION BY pair_index) - n)::INT AS step, CASE WHEN st = 3 THEN -1 ELSE i - 1 END::INT AS q, CASE WHEN st = 2 THEN -1 ELSE j - 1 END::INT AS t,
         CASE WHEN st = 1 THEN s[i][j] ELSE 0.0 END AS residue_score
  FROM walk WHERE st > 0 AND i > 0 AND j > 0
),
ap AS MATERIALIZED (SELECT h.pair_index, count(x.step)::INT AS aligned FROM hard h LEFT JOIN (SELECT pair_index, step FROM steps WHERE q >= 0 AND t >= 0) x USING (pair_index) GROUP BY h.pair_index)"""
MPNN, ESM = (-1.4, -0.15), (-1.01982, 0.225736)
HARD = _hard(*MPNN)
PATHS = HARD + _WALK

_SOFT = f"""
WITH RECURSIVE {BASE}, {_pairs()},
z AS (
  SELECT pair_index, 1 AS d, lq, lt, s, list_transform(range(lq + 1), lambda i: 0.0::DOUBLE) AS m1, list_transform(range(lq + 1), lambda i: 0.0::DOUBLE) AS i1, list_transform(range(lq + 1), lambda i: 0.0::DOUBLE) AS d1,
         list_transform(range(lq + 1), lambda i: 0.0::DOUBLE) AS m2, list_transform(range(lq + 1), lambda i: 0.0::DOUBLE) AS i2, list_transform(range(lq + 1), lambda i: 0.0::DOUBLE) AS d2, 1.0::DOUBLE AS total
  FROM pairs
  UNION ALL
  SELECT pair_index, d, lq, lt, s, m, ins, del, m1, i1, d1, total + list_sum(m) + list_sum(ins) + list_sum(del)
  FROM (
    SELECT pair_index, d + 1 AS d, lq, lt, s, m1, i1, d1, total,
      list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > lt THEN 0.0 ELSE exp(s[i][d + 1 - i]) * (1 + m2[i] + i2[i] + d2[i]) END) AS m,
      list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > lt THEN 0.0 ELSE m1[i] * exp(-3.21337) + i1[i] * exp(-0.111704) END) AS ins,
      list_transform(range(lq + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > lt THEN 0.0 ELSE m1[i + 1] * exp(-3.21337) + d1[i + 1] * exp(-0.111704) END) AS del
    FROM z WHERE d < lq + lt
  )
),
soft AS MATERIALIZED (SELECT pair_index, ln(total) AS log_z FROM z WHERE d = lq + lt)"""

_MATCH = """,
mt AS MATERIALIZED (
  SELECT s.pair_index, h.lq, h.lt, a.x AS qx, a.y AS qy, a.z AS qz, b.x AS tx, b.y AS ty, b.z AS tz, a.code AS qc, b.code AS tc, a.observed AND b.observed AS seen
  FROM steps s JOIN hard h USING (pair_index) JOIN r a ON a.idx = h.q AND a.k = s.q JOIN r b ON b.idx = h.t AND b.k = s.t WHERE s.q >= 0 AND s.t >= 0
)"""
_MOMENTS = (
    ",\nmo AS MATERIALIZED (SELECT pair_index, count(*)::BIGINT AS n, "
    + ", ".join(f"avg({s}{c}) AS {s}{c}" for s in "qt" for c in "xyz")
    + ", "
    + ", ".join(f"sum({s}x * {s}x + {s}y * {s}y + {s}z * {s}z) - (sum({s}x) ** 2 + sum({s}y) ** 2 + sum({s}z) ** 2) / count(*) AS {s}{s}" for s in "qt")
    + ", "
    + ", ".join(f"sum(t{a} * q{b}) - sum(t{a}) * sum(q{b}) / count(*) AS s{a}{b}" for a in "xyz" for b in "xyz")
    + " FROM mt WHERE seen GROUP BY pair_index)"
)


def _gram(a: str, b: str) -> str:
    return " + ".join(f"s{c}{a} * s{c}{b}" for c in "xyz")


#: Singular values of the cross-moments by the trigonometric cubic, with the sign of the determinant on the smallest.
_SPECTRUM = f""",
g AS (SELECT *, {", ".join(f"{_gram(a, b)} AS g{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))},
  sxx * (syy * szz - syz * szy) - sxy * (syx * szz - syz * szx) + sxz * (syx * szy - syy * szx) AS det FROM mo WHERE n >= 3),
g1 AS (SELECT *, (gxx + gyy + gzz) / 3 AS mid FROM g),
g2 AS (SELECT *, sqrt(((gxx - mid) ** 2 + (gyy - mid) ** 2 + (gzz - mid) ** 2 + 2 * (gxy ** 2 + gxz ** 2 + gyz ** 2)) / 6) AS w FROM g1),
g3 AS (SELECT *, acos(greatest(-1, least(1, ((gxx - mid) * ((gyy - mid) * (gzz - mid) - gyz ** 2) - gxy * (gxy * (gzz - mid) - gyz * gxz) + gxz * (gxy * gyz - (gyy - mid) * gxz)) / (2 * w ** 3)))) / 3 AS phi FROM g2),
g4 AS (SELECT *, mid + 2 * w * cos(phi) AS e1, mid + 2 * w * cos(phi + 2 * pi() / 3) AS e3 FROM g3),
g5 AS (SELECT *, 3 * mid - e1 - e3 AS e2 FROM g4),
g6 AS MATERIALIZED (SELECT *, sqrt(greatest(0, (qq + tt - 2 * (sqrt(e1) + sqrt(greatest(e2, 0)) + sign(det) * sqrt(greatest(e3, 0)))) / n)) AS rmsd,
  1 / sqrt(e1) AS f1, 1 / sqrt(e2) AS f2, sign(det) / sqrt(e3) AS f3 FROM g5)"""


def _rotation() -> str:
    """R = f(G) S' with f(e) = 1 / sqrt(e) by Newton's divided differences on the three eigenvalues."""
    sym = lambda a, b: "g" + "".join(sorted(a + b))
    shifted = lambda a, b, e: f"({sym(a, b)}{' - ' + e if a == b else ''})"
    f = ", ".join(f"{'f1 + ' if a == b else ''}u * {shifted(a, b, 'e1')} + v * ({' + '.join(shifted(a, c, 'e1') + ' * ' + shifted(c, b, 'e2') for c in 'xyz')}) AS h{a}{b}" for a in "xyz" for b in "xyz")
    rot = ", ".join(f"{' + '.join(f'h{a}{c} * s{b}{c}' for c in 'xyz')} AS r{a}{b}" for a in "xyz" for b in "xyz")
    return f""",
u1 AS (SELECT *, (f2 - f1) / (e2 - e1) AS u, ((f3 - f2) / (e3 - e2) - (f2 - f1) / (e2 - e1)) / (e3 - e1) AS v FROM g6),
u2 AS (SELECT *, {f} FROM u1),
rot AS MATERIALIZED (SELECT pair_index, qx AS mqx, qy AS mqy, qz AS mqz, tx AS mtx, ty AS mty, tz AS mtz, {rot} FROM u2)"""


_TM = ",\nd AS (SELECT m.*, " + " + ".join(f"(r{c}x * (tx - mtx) + r{c}y * (ty - mty) + r{c}z * (tz - mtz) - (q{c} - mq{c})) ** 2" for c in "xyz") + " AS d2 FROM mt m JOIN rot USING (pair_index) WHERE seen)"
_D0 = "greatest(0.5, 1.24 * cbrt(greatest({0} - 15, 1)) - 1.8)"


def _lddt() -> str:
    def side(mine: str, other: str, a: str, b: str) -> str:
        return f"""
  SELECT h.pair_index, count(*) AS n, count(*) FILTER (WHERE oi.k IS NOT NULL AND oj.k IS NOT NULL) AS m,
         sum(CASE WHEN oi.k IS NOT NULL AND oj.k IS NOT NULL THEN {" + ".join(f"(abs(c.d - sqrt((oi.x - oj.x) ** 2 + (oi.y - oj.y) ** 2 + (oi.z - oj.z) ** 2)) <= {cut} + 1e-12)::INT" for cut in (0.5, 1.0, 2.0, 4.0))} ELSE 0 END) AS kept
  FROM hard h JOIN contacts c ON c.idx = h.{mine}
  LEFT JOIN steps si ON si.pair_index = h.pair_index AND si.{a} = c.i AND si.{b} >= 0 LEFT JOIN steps sj ON sj.pair_index = h.pair_index AND sj.{a} = c.j AND sj.{b} >= 0
  LEFT JOIN r oi ON oi.idx = h.{other} AND oi.k = si.{b} AND oi.observed LEFT JOIN r oj ON oj.idx = h.{other} AND oj.k = sj.{b} AND oj.observed
  GROUP BY h.pair_index"""

    return f""",
contacts AS MATERIALIZED (SELECT a.idx, a.k AS i, b.k AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM r a JOIN r b ON a.idx = b.idx AND a.k < b.k WHERE a.observed AND b.observed AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 15),
ca AS ({side("q", "t", "q", "t")}), cb AS ({side("t", "q", "t", "q")})"""


_V = "list_slice(e, 1, 21)"
_ITEMS = "SELECT vec_id, (i - 1)::INT AS k, round(value, 6) AS value FROM (SELECT vec_id, unnest({0}) AS value, unnest(range(1, len({0}) + 1)) AS i FROM {1})"
_WITH = f"WITH {BASE}"
_TOKEN = f"CASE WHEN strpos('{_AA}', c) > 0 THEN strpos('{_AA}', c) - 1 WHEN strpos('BUZOX', c) > 0 THEN 19 ELSE 24 END"
_ERF = "sign(x / sqrt(2)) * (1 - (1 / (1 + 0.3275911 * abs(x / sqrt(2)))) * (0.254829592 + (1 / (1 + 0.3275911 * abs(x / sqrt(2)))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs(x / sqrt(2)))) * (1.421413741 + (1 / (1 + 0.3275911 * abs(x / sqrt(2)))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs(x / sqrt(2)))) * 1.061405429)))) * exp(-x * x / 2))"


_SPLITMIX = """
, s0 AS (SELECT {key}, (({seed}::HUGEINT + 11400714819323198485) % 18446744073709551616)::UBIGINT AS a, {rest} FROM {source}),
s1 AS (SELECT *, xor(a, a >> 30) AS b FROM s0),
s2 AS (SELECT *, (((b & 4294967295)::HUGEINT * 13787848793156543929 + (((b >> 32)::HUGEINT * 13787848793156543929) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT AS c FROM s1),
s3 AS (SELECT *, xor(c, c >> 27) AS d FROM s2),
s4 AS (SELECT *, (((d & 4294967295)::HUGEINT * 10723151780598845931 + (((d >> 32)::HUGEINT * 10723151780598845931) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT AS f FROM s3),
s5 AS (SELECT *, xor(f, f >> 31) AS bits FROM s4)
"""


def _summary() -> str:
    """The 25 text columns, from the parts above; numbers have six significant digits."""
    g = lambda v: f"coalesce(printf('%.6g', {v}), 'NA')"
    columns = {
        "query_index": "h.q::VARCHAR", "target_index": "h.t::VARCHAR", "pair_id": "a.input_id || '__' || b.input_id", "raw_sw_score": g("best"), "soft_sw_score": g("log_z"),
        "sw_per_query_len": g("CASE WHEN aligned > 0 THEN best / h.lq END"), "sw_per_target_len": g("CASE WHEN aligned > 0 THEN best / h.lt END"), "sw_per_aligned": g("CASE WHEN aligned > 0 THEN best / aligned END"),
        "aligned_pairs": "aligned::VARCHAR", "coverage_query": g("aligned / h.lq"), "coverage_target": g("aligned / h.lt"), "coverage_mean": g("2 * aligned / (h.lq + h.lt)"), "identity": g("identity"),
        "rmsd": g("rmsd"), "tm_score_query": g("tq"), "tm_score_target": g("tm.tt"), "lddt": g("(ca.kept / 4 / ca.n + cb.kept / 4 / cb.n) / 2"), "lddt_byA": g("ca.kept / 4 / ca.n"), "lddt_byB": g("cb.kept / 4 / cb.n"),
        "lddt_aln": g("(ca.kept + cb.kept) / 4 / nullif(ca.m + cb.m, 0)"), "coverage_byA": g("ca.m / ca.n"), "coverage_byB": g("cb.m / cb.n"), "ecs": "'NA'", "fasta_path": "'NA'", "pdb_path": "'NA'",
    }
    return f"""{PATHS}{_MATCH}{_MOMENTS}{_SPECTRUM}{_rotation()}{_TM}{_lddt()},
tm AS (SELECT pair_index, sum(1 / (1 + d2 / {_D0.format('lq')} ** 2)) / any_value(lq) AS tq, sum(1 / (1 + d2 / {_D0.format('lt')} ** 2)) / any_value(lt) AS tt FROM d GROUP BY pair_index),
same AS (SELECT pair_index, avg((qc = tc)::INT) AS identity FROM mt GROUP BY pair_index),
z AS ({_SOFT} SELECT pair_index, log_z FROM soft)
SELECT h.pair_index, {", ".join(f'{v} AS "{k}"' for k, v in columns.items())}
FROM hard h JOIN ap USING (pair_index) JOIN p a ON a.idx = h.q JOIN p b ON b.idx = h.t LEFT JOIN z USING (pair_index) LEFT JOIN same USING (pair_index) LEFT JOIN g6 USING (pair_index)
LEFT JOIN tm USING (pair_index) LEFT JOIN ca USING (pair_index) LEFT JOIN cb USING (pair_index)"""


def oracle_sql() -> dict[str, str]:
    pair_base = f"WITH {BASE}"
    atoms = f"""{_WITH}, atoms AS (
  SELECT input_id, idx, vec_id AS record, (vec_id // 40)::INT AS resnum, CASE WHEN vec_id % 40 < 20 THEN '' ELSE 'A' END AS icode,
         ['N', 'CA', 'C', 'O', 'CB'][(vec_id % 5 + 1)::INT] AS atom, ['B', '', 'A', 'C'][((vec_id // 5) % 4 + 1)::INT] AS altloc FROM r
), best AS (
  SELECT input_id, idx, resnum, icode, atom, arg_min(altloc, (CASE altloc WHEN '' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) * 10000000000 + record) AS altloc,
         arg_min(record, (CASE altloc WHEN '' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) * 10000000000 + record) AS record
  FROM atoms GROUP BY ALL
)"""
    return {
        "pair_enumeration": f"{pair_base} SELECT {_index(0)} AS pair_index, a.idx AS query_index, b.idx AS target_index FROM p a JOIN p b ON a.idx < b.idx",
        "pair_enumeration_self": f"{pair_base} SELECT {_index(1)} AS pair_index, a.idx AS query_index, b.idx AS target_index FROM p a JOIN p b ON a.idx <= b.idx",
        "pair_index_decode": """
WITH n AS (SELECT count(*) AS n FROM nation)
SELECT (row_number() OVER (PARTITION BY s ORDER BY i, j) - 1)::BIGINT AS pair_index, i::BIGINT AS i, j::BIGINT AS j, s AS include_self
FROM (SELECT unnest(range(n)) AS i FROM n), (SELECT unnest(range(n)) AS j FROM n), (SELECT unnest([true, false]) AS s) WHERE i < j OR (s AND i = j)""",
        "pair_tiles": f"""{pair_base}, t AS (SELECT unnest(range((n + 2) // 3))::INT AS w FROM np)
SELECT least(idx // 3, w)::INT AS ti, greatest(idx // 3, w)::INT AS tj, count(*)::BIGINT AS members, sum((idx // 3 > w)::INT)::BIGINT AS second_side FROM p, t GROUP BY ALL""",
        "pair_list_join": f"""{pair_base} SELECT l.pair_index, qi AS query_id, ti AS target_id, a.idx AS query_index, b.idx AS target_index
FROM (VALUES (0::BIGINT, 'p0', 'p1'), (1, 'p3', 'p0'), (2, 'p0', 'p1'), (3, 'p2', 'p2'), (4, 'p1', 'p0')) l(pair_index, qi, ti) JOIN p a ON a.input_id = qi JOIN p b ON b.input_id = ti""",
        "encode_once_set": f"{pair_base} SELECT idx, input_id FROM p WHERE input_id IN ('p0', 'p1', 'p2', 'p3')",
        "ambiguous_ids": "SELECT o_orderpriority AS input_id, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders UNION SELECT o_orderstatus FROM orders) GROUP BY 1 HAVING count(*) > 1",
        "missing_ids": "SELECT DISTINCT n_name || '?' AS input_id FROM nation",
        "pair_cost": f"{pair_base} SELECT {_index(0)} AS pair_index, (a.n::BIGINT * b.n)::BIGINT AS cost FROM p a JOIN p b ON a.idx < b.idx",
        "hard_alignment": f"{PATHS} SELECT pair_index, q AS query_index, t AS target_index, round(best, 6) AS raw_sw_score, aligned AS aligned_pairs FROM hard JOIN ap USING (pair_index)",
        "hard_alignment_positive_extension": f"{_hard(*ESM)}{_WALK} SELECT pair_index, round(best, 6) AS raw_sw_score, aligned AS aligned_pairs FROM hard JOIN ap USING (pair_index)",
        "hard_alignment_self": f"{_hard(*MPNN, own=1)} SELECT pair_index, q AS query_index, t AS target_index, round(best, 6) AS raw_sw_score FROM hard",
        "pair_list_alignment": f"{_hard(*MPNN, listed=True)}{_WALK} SELECT pair_index, q AS query_index, t AS target_index, round(best, 6) AS raw_sw_score, aligned AS aligned_pairs FROM hard JOIN ap USING (pair_index)",
        "path_steps": f"{PATHS} SELECT pair_index, step, q, t, round(residue_score, 6) AS residue_score FROM steps",
        "path_spans": f"""{PATHS} SELECT h.pair_index, coalesce(min(s.q), -1)::INT AS query_start, coalesce(max(s.q), -1)::INT AS query_end, coalesce(min(s.t), -1)::INT AS target_start, coalesce(max(s.t), -1)::INT AS target_end
FROM hard h LEFT JOIN (SELECT pair_index, q, t FROM steps WHERE q >= 0 AND t >= 0) s ON s.pair_index = h.pair_index GROUP BY h.pair_index""",
        "soft_log_partition": f"{_SOFT} SELECT pair_index, round(log_z, 6) AS log_partition FROM soft",
        "both_modes": f"""SELECT pair_index, raw_sw_score, aligned_pairs, soft_sw_score FROM ({PATHS} SELECT pair_index, round(best, 6) AS raw_sw_score, aligned AS aligned_pairs FROM hard JOIN ap USING (pair_index))
JOIN ({_SOFT} SELECT pair_index, round(log_z, 6) AS soft_sw_score FROM soft) USING (pair_index)""",
        "similarity_stats": f"""{pair_base}, c AS (SELECT a.idx AS qi, b.idx AS ti, list_inner_product(x.e, y.e) AS v FROM p a JOIN p b ON a.idx < b.idx JOIN r x ON x.idx = a.idx JOIN r y ON y.idx = b.idx)
SELECT {_index(0)} AS pair_index, count(*)::BIGINT AS cells, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(avg(v), 6) AS mean FROM c JOIN p a ON a.idx = qi JOIN p b ON b.idx = ti GROUP BY a.idx, b.idx""",
        "coverage": f"{PATHS} SELECT pair_index, round(aligned / lq, 6) AS coverage_query, round(aligned / lt, 6) AS coverage_target, round(2 * aligned / (lq + lt), 6) AS coverage_mean FROM hard JOIN ap USING (pair_index)",
        "identity": f"{PATHS}{_MATCH} SELECT pair_index, round(avg((qc = tc)::INT), 6) AS identity FROM mt GROUP BY pair_index",
        "length_normalised_scores": f"{PATHS} SELECT pair_index, CASE WHEN aligned > 0 THEN round(best / lq, 6) END AS sw_per_query_len, CASE WHEN aligned > 0 THEN round(best / lt, 6) END AS sw_per_target_len, CASE WHEN aligned > 0 THEN round(best / aligned, 6) END AS sw_per_aligned FROM hard JOIN ap USING (pair_index)",
        "superposition_moments": f"{PATHS}{_MATCH}{_MOMENTS} SELECT pair_index, n, {', '.join(f'round({c}, 5) AS {c}' for c in [*(s + c for s in 'qt' for c in 'xyz'), 'qq', 'tt', *('s' + a + b for a in 'xyz' for b in 'xyz')])} FROM mo",
        "rmsd": f"{PATHS}{_MATCH}{_MOMENTS}{_SPECTRUM} SELECT mo.pair_index, round(rmsd, 5) AS rmsd FROM mo LEFT JOIN g6 USING (pair_index)",
        "tm_score": f"{PATHS}{_MATCH}{_MOMENTS}{_SPECTRUM}{_rotation()}{_TM} SELECT pair_index, round(sum(1 / (1 + d2 / {_D0.format('lq')} ** 2)) / any_value(lq), 5) AS tm_score_query, round(sum(1 / (1 + d2 / {_D0.format('lt')} ** 2)) / any_value(lt), 5) AS tm_score_target FROM d GROUP BY pair_index",
        "contact_pairs": f"{_WITH} SELECT a.idx, a.k AS i, b.k AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS d FROM r a JOIN r b ON a.idx = b.idx AND a.k < b.k WHERE a.observed AND b.observed AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 6",
        "lddt": f"""{PATHS}{_lddt()} SELECT h.pair_index, round((ca.kept / 4 / ca.n + cb.kept / 4 / cb.n) / 2, 6) AS lddt, round(ca.kept / 4 / ca.n, 6) AS "lddt_byA", round(cb.kept / 4 / cb.n, 6) AS "lddt_byB",
round((ca.kept + cb.kept) / 4 / nullif(ca.m + cb.m, 0), 6) AS lddt_aln, round(ca.m / ca.n, 6) AS "coverage_byA", round(cb.m / cb.n, 6) AS "coverage_byB" FROM hard h LEFT JOIN ca USING (pair_index) LEFT JOIN cb USING (pair_index)""",
        "metric_panel": f"""{PATHS}{_MATCH}{_MOMENTS}{_SPECTRUM}{_rotation()}{_TM}{_lddt()},
tm AS (SELECT pair_index, sum(1 / (1 + d2 / {_D0.format('lq')} ** 2)) / any_value(lq) AS tq, sum(1 / (1 + d2 / {_D0.format('lt')} ** 2)) / any_value(lt) AS tt FROM d GROUP BY pair_index),
same AS (SELECT pair_index, avg((qc = tc)::INT) AS identity FROM mt GROUP BY pair_index)
SELECT h.pair_index, round(identity, 5) AS identity, round(rmsd, 5) AS rmsd, round(tq, 5) AS tm_score_query, round(tm.tt, 5) AS tm_score_target, round((ca.kept / 4 / ca.n + cb.kept / 4 / cb.n) / 2, 5) AS lddt, NULL::DOUBLE AS ecs, 'Unimplemented' AS ecs_reason
FROM hard h LEFT JOIN same USING (pair_index) LEFT JOIN g6 USING (pair_index) LEFT JOIN tm USING (pair_index) LEFT JOIN ca USING (pair_index) LEFT JOIN cb USING (pair_index)""",
        "score_alignment": f"""{pair_base} SELECT l.pair_index, least(a.n, b.n)::INT AS aligned_pairs, round(least(a.n, b.n) / a.n, 6) AS coverage_query, round(least(a.n, b.n) / b.n, 6) AS coverage_target, round(2 * least(a.n, b.n) / (a.n + b.n), 6) AS coverage_mean,
round(list_avg(list_transform(range(1, least(a.n, b.n) + 1), lambda i: (a.codes[i] = b.codes[i])::INT)), 6) AS identity
FROM (VALUES (0::BIGINT, 'p0', 'p1'), (1, 'p3', 'p0'), (2, 'p0', 'p1'), (3, 'p2', 'p2'), (4, 'p1', 'p0')) l(pair_index, qi, ti) JOIN p a ON a.input_id = qi JOIN p b ON b.input_id = ti""",
        "result_rollup": f"{HARD} SELECT q AS query_index, count(*)::BIGINT AS pairs, round(avg(best), 6) AS mean_score, round(max(best), 6) AS best_score FROM hard GROUP BY q",
        "knn_residues": f"""{_WITH}, n AS (SELECT a.idx, a.k AS i, b.k AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 + 1e-6 AS d2 FROM r a JOIN r b ON a.idx = b.idx WHERE a.observed AND b.observed)
SELECT idx, i, slot, j, round(d2, 6) AS d2 FROM (SELECT *, (row_number() OVER (PARTITION BY idx, i ORDER BY d2, j) - 1)::INT AS slot FROM n) WHERE slot < 8""",
        "gathered_messages": f"""{_WITH}, n AS (SELECT a.idx, a.k AS i, b.k AS j, b.x, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 + 1e-6 AS d2 FROM r a JOIN r b ON a.idx = b.idx WHERE a.observed AND b.observed)
SELECT idx, i, round(sum(x) / 30, 6) AS message FROM (SELECT *, row_number() OVER (PARTITION BY idx, i ORDER BY d2, j) AS slot FROM n) WHERE slot <= 8 GROUP BY idx, i""",
        "rbf_expansion": f"{_WITH}, v AS (SELECT vec_id, x + 8 AS d, unnest(range(16))::INT AS centre FROM r) SELECT vec_id, centre, round(CASE WHEN d < 0 THEN 0 ELSE exp(-((d - (2 + centre * (20.0::DOUBLE / 15))) ** 2) / (2 * (20.0::DOUBLE / (16 * sqrt(2))) ** 2)) END, 6) AS value FROM v",
        "positional_classes": f'{_WITH} SELECT CASE WHEN a.observed = b.observed THEN greatest(-32, least(32, a.k - b.k)) + 32 ELSE 65 END::INT AS "class", count(*)::BIGINT AS n FROM r a JOIN r b USING (idx) GROUP BY 1',
        "virtual_cb": f"""{_WITH}, v AS (SELECT vec_id, e, e[4] - e[1] AS b_x, e[5] - e[2] AS b_y, e[6] - e[3] AS b_z, e[7] - e[4] AS c_x, e[8] - e[5] AS c_y, e[9] - e[6] AS c_z FROM r)
SELECT vec_id, round(e[4] - 0.58273431 * (b_y * c_z - b_z * c_y) + 0.56802827 * b_x - 0.54067466 * c_x, 6) AS x, round(e[5] - 0.58273431 * (b_z * c_x - b_x * c_z) + 0.56802827 * b_y - 0.54067466 * c_y, 6) AS y, round(e[6] - 0.58273431 * (b_x * c_y - b_y * c_x) + 0.56802827 * b_z - 0.54067466 * c_z, 6) AS z FROM v""",
        "softmax_rows": f"{_WITH}, v AS (SELECT vec_id, list_transform({_V}, lambda x: exp(x / 0.5)) AS w FROM r), f AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS o FROM v) " + _ITEMS.format("o", "f"),
        "log_softmax_rows": f"{_WITH}, v AS (SELECT vec_id, {_V} AS w, ln(list_sum(list_transform({_V}, lambda x: exp(x)))) AS z FROM r), f AS (SELECT vec_id, list_transform(w, lambda x: x - z) AS o FROM v) " + _ITEMS.format("o", "f"),
        "layer_norm_rows": f"{_WITH}, v AS (SELECT vec_id, {_V} AS w, list_avg({_V}) AS m FROM r), v2 AS (SELECT *, list_avg(list_transform(w, lambda x: (x - m) * (x - m))) AS s FROM v), f AS (SELECT vec_id, list_transform(w, lambda x: (x - m) / sqrt(s + 1e-5)) AS o FROM v2) " + _ITEMS.format("o", "f"),
        "gelu_values": f"{_WITH} SELECT vec_id, round(x * 0.5 * (1 + {_ERF}), 6) AS gelu FROM r",
        "axpy_rows": f"{_WITH}, f AS (SELECT vec_id, list_transform(range(1, 22), lambda i: 2.5 * e[i] + e[22 - i]) AS o FROM r) " + _ITEMS.format("o", "f"),
        "row_reductions": f"{_WITH} SELECT vec_id, round(list_sum({_V}), 6) AS total, round(list_avg({_V}), 6) AS mean, (list_position({_V}, list_max({_V})) - 1)::INT AS argmax FROM r",
        "gemm": f"{_WITH} SELECT a.k AS i, b.k AS j, round(list_inner_product(a.e, b.e), 6) AS value FROM r a JOIN r b ON a.idx = 0 AND b.idx = 1",
        "design_scores": f"""{_WITH}, v AS (SELECT idx, {_V} AS w, strpos('{_AA}', code) AS token FROM r)
SELECT idx, round(avg(-(w[token] - ln(list_sum(list_transform(w, lambda x: exp(x)))))), 6) AS score, round(avg((list_position(w, list_max(w)) = token)::INT), 6) AS recovery FROM v GROUP BY idx""",
        "splitmix_values": "WITH source AS (SELECT event_id FROM events)" + _SPLITMIX.format(key="event_id", seed="event_id", rest="1 AS one", source="source") + "SELECT event_id, CASE WHEN bits >= 9223372036854775808 THEN (bits::HUGEINT - 18446744073709551616)::BIGINT ELSE bits::BIGINT END AS bits, round((bits >> 11)::DOUBLE / 9007199254740992, 12) AS uniform FROM s5",
        "decode_order": f"{_WITH}" + _SPLITMIX.format(key="vec_id", seed="vec_id", rest="idx, k, observed", source="r") + """, o AS (SELECT idx, k, (row_number() OVER (PARTITION BY idx ORDER BY (observed::INT::DOUBLE + 1e-4) * ((bits >> 11)::DOUBLE / 9007199254740992), k) - 1)::INT AS rank FROM s5)
SELECT idx, k AS residue_index, rank, coalesce(lag(rank) OVER (PARTITION BY idx ORDER BY k) < rank, false) AS neighbour_before FROM o""",
        "tokenized": f"""WITH l AS (SELECT item_id, translate(regexp_replace(text, '[-*\\s]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM benchmark), c AS (SELECT item_id, unnest(range(1, length(s) + 1)) AS k, s FROM l),
t AS (SELECT item_id, k, {_TOKEN} AS token FROM (SELECT item_id, k, s[k] AS c FROM c) UNION ALL SELECT item_id, 0, 26 FROM l UNION ALL SELECT item_id, length(s) + 1, 27 FROM l)
SELECT item_id, token::INT AS token, count(*)::BIGINT AS n, min(k)::INT AS first FROM t GROUP BY item_id, token""",
        "residue_classification": "SELECT item_id, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "C", "PYL": "K", "SEP": "S", "TPO": "T", "PTR": "Y", "HYP": "P"}.items()) + "}[upper(trim(substr(text, 1, 3)))], 'X') AS code FROM benchmark UNION ALL SELECT n_nationkey::BIGINT, 'M' FROM nation",
        "artifact_names": "SELECT c_custkey, regexp_replace(CASE WHEN length((c_custkey + 1)::VARCHAR) > 4 THEN substr((c_custkey + 1)::VARCHAR, 1, 4) ELSE lpad((c_custkey + 1)::VARCHAR, 4, '0') END || '_' || c_name || '  (x).v2_' || CASE WHEN c_nationkey % 3 = 0 THEN 'A' ELSE 'B' END || '_model1', '[^A-Za-z0-9.\\-]+', '_', 'g') AS name FROM customer",
        "format_detection": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdb' WHEN 1 THEN 'mmcif' WHEN 3 THEN 'pdb' ELSE CASE WHEN p_size % 2 = 0 THEN 'mmcif' ELSE 'pdb' END END AS format FROM part",
        "alternate_locations": f"{atoms} SELECT input_id, resnum, icode, atom, altloc, record FROM best",
        "chain_breaks": atoms + """, res AS (
  SELECT input_id, resnum, icode, min(record) AS record, """ + ", ".join(f"max((atom = '{a}')::INT)::INT AS has_{a.lower()}" for a in ("N", "CA", "C", "O", "CB")) + """ FROM best GROUP BY ALL
), o AS (SELECT *, (row_number() OVER w - 1)::INT AS residue_index, lead(resnum) OVER w AS nn, lead(icode) OVER w AS ni FROM res WINDOW w AS (PARTITION BY input_id ORDER BY record))
SELECT input_id, residue_index, resnum, icode, coalesce(nn - resnum > 1 OR (nn = resnum AND icode <> '' AND ni = ''), false) AS break_after, has_n, has_ca, has_c, has_o, has_cb FROM o""",
        "pdb_scan": f"{_WITH} SELECT input_id, (vec_id % 100000)::INT AS serial, (k % 10000)::INT AS resnum, 'CA' AS atom, 'ALA' AS resname, 'A' AS chain, 1 AS model, round(floor(x * 1000) / 1000, 3) AS x, round(floor(y * 1000) / 1000, 3) AS y, round(floor(z * 1000) / 1000, 3) AS z FROM r",
        "fasta_scan": "SELECT 'item ' || item_id AS name, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark)",
        "pair_list_scan": "SELECT (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS pair_index, n_name AS query_id, n_regionkey::VARCHAR AS target_id FROM nation",
        "gapped_fasta": f"""{PATHS}, f AS (SELECT pair_index, string_agg(CASE WHEN s.q < 0 THEN '-' ELSE a.codes[s.q + 1] END, '' ORDER BY step) AS qs, string_agg(CASE WHEN s.t < 0 THEN '-' ELSE b.codes[s.t + 1] END, '' ORDER BY step) AS ts, any_value(a.input_id) AS qn, any_value(b.input_id) AS tn
FROM steps s JOIN hard h USING (pair_index) JOIN p a ON a.idx = h.q JOIN p b ON b.idx = h.t GROUP BY pair_index)
SELECT pair_index, qn || '__' || tn AS name, '>' || qn || chr(10) || regexp_replace(regexp_replace(qs, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') || chr(10) || '>' || tn || chr(10) || regexp_replace(regexp_replace(ts, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') || chr(10) AS fasta FROM f""",
        "package_table": """SELECT * FROM (VALUES ('structure-d64', 'structure', 64::INT, -1.4::DOUBLE, -0.15::DOUBLE, -3.21337::DOUBLE, -0.111704::DOUBLE, 'align,encode,soft'),
('sequence-320', 'sequence', 320, -1.01982, 0.225736, -6.72805, -0.0159468, 'align,encode,soft'), ('design-128', 'design', 128, 0, 0, 0, 0, 'design'))
t(name, kind, dim, hard_gap_open, hard_gap_extension, soft_gap_open, soft_gap_extension, capabilities)""",
        "summary_table": _summary(),
        "cache_counters": "SELECT count(*) FILTER (WHERE vec_id % 7 <> 0 AND vec_id % 13 <> 0)::BIGINT AS hits, count(*) FILTER (WHERE vec_id % 7 = 0 OR vec_id % 13 = 0)::BIGINT AS misses, count(*) FILTER (WHERE vec_id % 7 <> 0 AND vec_id % 13 = 0)::BIGINT AS rejected FROM embeddings WHERE label IS NOT NULL",
    }
