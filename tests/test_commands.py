import pytest

from graphemica.__main__ import main
from graphemica.plans import catalogue


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "a.txt").write_text("Übung macht den Meister\nund das Üben auch\n")
    (tmp_path / "p.tsv").write_text("abcdef\tabcxef\nabc\tabc\n")
    (tmp_path / "x.xml").write_text('<PcGts xmlns="n"><Page><TextLine><TextEquiv><Unicode>eine Zeile</Unicode></TextEquiv></TextLine></Page></PcGts>')
    return tmp_path


@pytest.mark.parametrize("args,want", [
    (["alphabet", "a.txt"], "Ü\t220\t2"), (["coverage", "a.txt", "--alphabets", "ascii"], "ascii\t42\t2\t1"), (["merges", "a.txt", "--merges", "[('u', 'v')]"], "42\t"), (["information", "a.txt"], "a.txt\t42"),
    (["tree", "--letters", "abz"], "\t3"), (["map", "a.txt"], "Ubung macht"), (["page-text", "x.xml"], "eine Zeile"), (["cer", "--pairs", "p.tsv"], "0.1111"), (["full-cer", "--pairs", "p.tsv"], "\t1"), (["postcorrection-tsv", "--pairs", "p.tsv", "--min-length", "3"], "abcdef\tabcxef"),
])
def test_commands(spark, corpus, capsys, args, want):
    main([str(corpus / a) if (corpus / a).exists() else a for a in args])
    assert want in capsys.readouterr().out


def test_train_and_infer(spark, corpus, capsys):
    model = str(corpus / "m")
    main(["train", str(corpus / "a.txt"), "--model", model, "--ratio", "0.99"])
    main(["report", "--model", model])
    (corpus / "in.txt").write_text("Ubung")
    main(["infer", str(corpus / "in.txt"), "--model", model])
    assert "Übung" in capsys.readouterr().out
    net = str(corpus / "net")
    main(["train", str(corpus / "a.txt"), "--model", net, "--ratio", "0.5", "--network", "--epochs", "1"])
    main(["train", str(corpus / "a.txt"), "--model", net, "--ratio", "0.5", "--network", "--epochs", "1", "--resume", net, "--overwrite"])
    capsys.readouterr()
    main(["report", "--model", net])
    assert len(capsys.readouterr().out.splitlines()) == 3
    main(["infer", str(corpus / "in.txt"), "--model", net, "--network"])
    assert len(capsys.readouterr().out.splitlines()[1]) == 5


def test_field_of_lines_and_aligned_files(spark, corpus, capsys, monkeypatch):
    import io

    model = str(corpus / "m2")
    main(["train", str(corpus / "a.txt"), "--model", model, "--ratio", "0.99"])
    (corpus / "in.tsv").write_text("7\tUbung\tUbung\n8\n")
    capsys.readouterr()
    main(["infer-column", str(corpus / "in.tsv"), "--model", model, "--column", "1"])
    assert capsys.readouterr().out.splitlines() == ["line", "7\tÜbung\tUbung", "8"]
    for i in range(20):
        (corpus / f"{i}.ocr").write_text(f"[OCR_toInput] the qvick brown fox {i}\n[OCR_aligned] the qv@ick brown fox {i}\n[ GS_aligned] the qu@ick brown fox {i}\n".replace("qv@", "qv").replace("qu@", "qu"))
    main(["train-aligned", *(str(corpus / f"{i}.ocr") for i in range(20)), "--model", str(corpus / "m3")])
    head, row = capsys.readouterr().out.splitlines()
    told = dict(zip(head.split("\t"), row.split("\t")))
    assert int(told["n"]) > 0 and float(told["cer_before"]) > 0.02 > float(told["cer_after"])
    monkeypatch.setattr("sys.stdin", io.StringIO("abc\tabd\nxyz\n"))
    main(["cer", "--pairs", "-"])
    assert "0.3333" in capsys.readouterr().out


def test_every_query_has_columns(spark):
    small = "/root/testdata/sf0.001"
    for name in ("charset_coverage", "doc_information", "confusion_matrix", "cosine_topk"):
        assert catalogue.QUERIES[name](spark, small).columns
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 60


def test_nothing_else_imports_the_training_text_operators():
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
