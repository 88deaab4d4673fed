from pdfs import Paper

from textloom.pdf.engine import Engine
from textloom.pdf.make import text_pdf
from textloom.plans import job
from textloom.streaming import files


def leaflet() -> Paper:
    paper = Paper()
    note = paper.add({"Subtype": "Link", "A": {"S": "URI", "URI": b"https://orchard.example/"}})
    return paper.page(b"BT /Body 9 Tf 9 99 Td (Orchard open on Sunday) Tj ET").page(b"BT /Body 9 Tf 9 99 Td (Orchard closed in May) Tj ET", Annots=[note])


def test_job(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir(), out.mkdir()
    (src / "a.pdf").write_bytes(leaflet().table())
    said = []
    go = lambda *argv: (said.clear(), job.run(spark, ["-i", str(src), *argv], said.append))[1]
    assert go() == 1 and "no rules" in said[0]
    assert go("-r", "", "x", "--dry-run") == 1
    assert go("-r", "Orchard", "Garden", "--dry-run") == 0 and "2 in text" in said[0] and "nothing written" in said[-1] and not list(out.iterdir())
    assert go("-r", "Orchard", "Ж", "--strict", "-o", str(out)) == 2 and not list(out.iterdir())
    assert go("-r", "Orchard", "Garden", "-o", str(out)) == 0
    assert "Garden open" in Engine((out / "a.pdf").read_bytes()).text()[0][2]
    assert go("--dump-text") == 0 and said[0].endswith("Orchard open on Sunday") and said[-1].endswith("https://orchard.example/")
    (src / "b.pdf").write_bytes(b"broken")
    assert go("-r", "Orchard", "Garden", "-o", str(out), "--quiet") == 1


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(text_pdf(["one\ntwo", "three"]))
    rows = files.extract_text(files.stream_pdf(spark, str(src)))
    files.start(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one\ntwo", "three"]
