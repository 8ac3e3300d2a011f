import csv
import glob

import pytest

from overlapse import cli
from overlapse.sources import files as S
from overlapse.sources.results import reference_tag, result_name
from tests.test_golden import A, B


@pytest.fixture()
def lists(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name, rows in (("a", A), ("b", B)):
        (tmp_path / f"{name}.bed").write_text("# note\ntrack x\n" + "".join(f"{c}\t{s}\t{e}\tx\n" for c, s, e in rows))
    (tmp_path / "none.bed").write_text("chr1\t9\t3\n")
    (tmp_path / "one.txt").write_text(f"# list\n{tmp_path}/a.bed\n\n{tmp_path}/none.bed\n")
    (tmp_path / "two.txt").write_text(f"{tmp_path}/b.bed\n{tmp_path}/a.bed\n{tmp_path}/a.bed\n")
    return tmp_path


def rows(path, sep=","):
    (part,) = glob.glob(f"{path}/part-*")
    with open(part) as f:
        return list(csv.DictReader(f, delimiter=sep))


def test_default_run_is_mode_b_shape_ie(spark, lists):
    assert cli.run(["one.txt", "two.txt", "-p", "14", "-o", "x"], spark) == 0
    got = rows("x_hll_p14_jaccB_ie.csv")
    assert [(r["file1"], r["file2"]) for r in got] == [(a, b) for a in ("a.bed", "none.bed") for b in ("b.bed", "a.bed", "a.bed")]
    assert list(got[0]) == ["file1", "file2", "sketch_type", "mode", "precision", "num_hashes", "kmer_size", "window_size", "jaccard_similarity_ie"]
    assert float(got[0]["jaccard_similarity_ie"]) == pytest.approx(0.5334865217816395, rel=1e-12)
    assert [float(r["jaccard_similarity_ie"]) for r in got[1:]] == [1, 1, 0, 0, 0]


def test_full_metrics_of_mode_c_as_tsv(spark, lists):
    argv = ["one.txt", "two.txt", "-p", "14", "-o", "y", "--metrics", "--subB", "0.3", "--expA", "0.5", "--subB-method", "hash-threshold", "--format", "tsv"]
    assert cli.run(argv, spark) == 0
    first = rows("y_hll_p14_jaccC_expA0.50_B0.30_full.tsv", "\t")[0]
    assert float(first["reg_eq_similarity"]) == pytest.approx(0.49044585987261147, rel=1e-12)
    assert float(first["containment_AB"]) == pytest.approx(0.7111624703039, rel=1e-12)
    assert (first["subA"], first["subB"], first["expA"]) == ("1.0", "0.3", "0.5")


def test_narrow_form(spark, lists):
    assert cli.run(["one.txt", "two.txt", "-p", "14", "-o", "q", "--re", "--format", "query-tsv"], spark) == 0
    got = rows("q_hll_p14_jaccB_re.tsv", "\t")
    assert list(got[0]) == ["query", "reference", "reg_eq_similarity"] and [float(r["reg_eq_similarity"]) for r in got] == [pytest.approx(0.5360262008733624, rel=1e-12), 1, 1, 0, 0, 0]


def test_sequence_mode_and_references(spark, lists, tmp_path, capsys):
    seq = "ACGTTGCAAGCT" * 30
    (tmp_path / "s.fa").write_text(f">chr1 one\n{seq[:100]}\n{seq[100:]}\n>chr2\nNNNN{seq.lower()}\n>empty\n")
    (tmp_path / "t.fa").write_text(f">x\n{seq[::-1] * 2}\n")
    (tmp_path / "fa.txt").write_text("s.fa\nt.fa\n")
    assert cli.run(["fa.txt", "fa.txt", "-p", "10", "--re", "-o", "z"], spark) == 0
    got = rows("z_mnmzr_p10_jaccD_k8_w40_re.csv")
    assert list(got[0])[-3:] == ["reg_eq_similarity", "ref1", "ref2"] and got[0]["ref1"] == "NA"
    assert float(got[0]["reg_eq_similarity"]) == 1.0 == float(got[3]["reg_eq_similarity"])
    (tmp_path / "i.bed").write_text("chr1\t0\t200\nchr2\t4\t204\n")
    (tmp_path / "u.bed").write_text("chr9\t0\t200\n")
    (tmp_path / "il.txt").write_text("i.bed\n")
    (tmp_path / "ul.txt").write_text("u.bed\n")
    assert cli.run(["il.txt", "il.txt", "--ref", "s.fa", "-p", "10", "-o", "r"], spark) == 0
    assert float(rows("r_s-vs-s_mnmzr_p10_jaccD_k8_w40_ie.csv")[0]["jaccard_similarity_ie"]) == 1.0
    assert cli.run(["ul.txt", "il.txt", "--ref", "s.fa", "-p", "10"], spark) == 2
    (tmp_path / "u.bed").write_text("chr1\t0\t200\nchr1\t300\t361\n")
    assert cli.run(["ul.txt", "il.txt", "--ref", "s.fa", "-p", "10"], spark) == 2
    assert "reach beyond" in capsys.readouterr().err
    (tmp_path / "n.fa").write_text(f">chr1\n{'N' * 300}{seq}\n>chr2\n{seq}\n")
    assert cli.run(["il.txt", "il.txt", "--ref", "n.fa", "-p", "10", "-o", "n"], spark) == 0
    assert "is N" not in capsys.readouterr().err
    (tmp_path / "i.bed").write_text("chr1\t0\t310\n")
    assert cli.run(["il.txt", "il.txt", "--ref", "n.fa", "-p", "10", "-o", "n"], spark) == 0
    assert "97% of the sequence of i.bed is N" in capsys.readouterr().err


def test_inputs_that_cannot_be_used(spark, lists, tmp_path, capsys):
    assert cli.run(["a.bed", "two.txt"], spark) == 2
    (tmp_path / "gz.bed").write_bytes(b"\x1f\x8b\x08\x00rest")
    (tmp_path / "gz.txt").write_text("gz.bed\n")
    (tmp_path / "empty.txt").write_text("# nothing\n")
    assert cli.run(["gz.txt", "two.txt"], spark) == 2
    assert cli.run(["empty.txt", "two.txt"], spark) == 2
    assert cli.run(["missing.txt", "two.txt"], spark) == 2
    for argv in (["--ref", "x", "--ref1", "y"], ["--ref1", "x"], ["--ref", "x", "--mode", "B"], ["--ref-cache-dir", "x"], ["-p", "3"], ["--subB", "2"], ["--metrics", "--re"]):
        with pytest.raises(SystemExit) as e:
            cli.run(["one.txt", "two.txt", *argv], spark)
        assert e.value.code == 2


def test_kinds_and_modes(tmp_path):
    (tmp_path / "x.dat").write_text("#h\nchr1\t1\t2\n")
    (tmp_path / "y.dat").write_text("\n>s\nACGT\n")
    (tmp_path / "z.dat").write_text("hello\n")
    kind = lambda n: S.file_kind(str(tmp_path / n))
    assert [kind(n) for n in ("x.dat", "y.dat", "z.dat", "q.narrowPeak", "q.FA.gz", "none")] == ["interval", "sequence", None, "interval", "sequence", None]
    mode = lambda n, **k: S.mode_of([str(tmp_path / n)], None, k.get("a", 1.0), k.get("e", 0))[0]
    assert [mode("x.dat"), mode("x.dat", a=0.5), mode("x.dat", e=1), mode("y.dat"), mode("z.dat")] == ["B", "C", "C", "D", "B"]


def test_names():
    assert result_name("o", "B", 18) == "o_hll_p18_jaccB_ie"
    assert result_name("o", "C", 12, "full", 0.5, 0.001) == "o_hll_p12_jaccC_A0.50_B0.0010_full"
    assert result_name("o", "D", 18, "re", k=20, w=100) == "o_mnmzr_p18_jaccD_k20_w100_re"
    assert [reference_tag(s) for s in ("GRCh38", "/x/my genome.fa.gz", "https://h/a.fna?x=1")] == ["hg38", "my_genome", "a"]


def test_record_lines(spark):
    lines = [
        "chr1 100 200", "  chr1\t100\t200abc", "track7\t1\t2", "@x", "", None, "chr1\t100.5\t200", "chr1\t-5\t9", "chr1\t9\t9", "chr1\t9",
        "chr1\t1\t99999999999999999999", "chr1\t+1\t+5  ", "chr1 5-7", "chr1\t12345",
    ]
    got = S.parse_records(spark.createDataFrame([(x,) for x in lines], "value string")).select("chrom", "start", "end").collect()
    assert sorted(map(tuple, got)) == [("chr1", 1, 5), ("chr1", 100, 200), ("chr1", 100, 200)]
