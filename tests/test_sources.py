"""Files in and out, cells and the stream."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.sources import cells as C
from veilspark.sources import files
from veilspark.streaming import incremental

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx(paragraphs, table):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('Head')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {W}>{p('Foot')}</w:ftr>")
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("Éa\r\nb\rc".encode())
    (tmp_path / "b.csv").write_bytes("x;y\n1;é\n;\n".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(_docx(["One", "", "Two"], [["r1", "r2"]]))
    (tmp_path / "d.xlsx").write_bytes(C.xlsx_bytes([("S", {(1, 1): "v & w", (2, 28): "far"}), ("T", {(1, 2): "t"})]))
    (tmp_path / "e_pseudonymized.txt").write_text("ours")
    (tmp_path / "f.png").write_bytes(b"x")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "sub" / "g.md").write_text("deep")
    return tmp_path


def test_documents(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_documents(spark, str(folder)).collect()}
    assert set(got) == {"a.txt", "b.csv", "c.docx", "d.xlsx", "bad.docx"}
    assert got["a.txt"].text == "Éa\nb\nc"
    assert got["b.csv"].text == "x\ty\n1\té"
    assert got["c.docx"].text == "Head\nOne\nTwo\nr1\tr2\nFoot"
    assert got["d.xlsx"].text == "v & w\nfar\n\nt"
    assert got["bad.docx"].text is None and "BadZipFile" in got["bad.docx"].error
    names = [r.path.rsplit("/", 1)[-1] for r in files.discovered(spark, str(folder), recursive=True).collect()]
    assert "g.md" in names and "f.png" not in names and names == sorted(names, key=lambda n: ("sub/" if n == "g.md" else "") + n)
    assert files.read_text(spark, str(folder / "a.txt")).first().text == "Éa\nb\nc"


def test_cells(spark, folder):
    rows = C.read_cells(spark, str(folder))
    got = {(r.path.rsplit("/", 1)[-1], r.cell_ref): r.value for r in rows.collect()}
    assert got["d.xlsx", "S!AB2"] == "far" and got["d.xlsx", "T!B1"] == "t" and got["b.csv", "B2"] == "é" and len(got) == 7
    books = C.workbooks(rows).collect()
    again = {b.path.rsplit("/", 1)[-1]: files.xlsx_sheets(bytes(b.content)) for b in books}
    assert dict(again["d.xlsx"])["S"] == {(1, 1): "v & w", (2, 28): "far"}
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in C.sheet_texts(rows.where("sheet_name <> 'S'"), ["path"]).collect()}
    assert texts["b.csv"] == "x\ty\n1\té" and texts["d.xlsx"] == "\tt"


def test_text_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "one\ntwo\n"), ("b.txt", "é")], "name string, text string")
    files.write_text(docs, str(tmp_path / "out"))
    back = files.read_text(spark, str(tmp_path / "out" / "*")).collect()
    assert sorted(r.text for r in back) == ["one\ntwo\n", "é"]  # as they are, without a line end of our own


def test_annotations(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"document_name": "x.txt", "entities": [{"entity_text": "A", "entity_type": "ORG", "start_pos": 1, "end_pos": 2}]}))
    row = files.read_annotations(spark, str(tmp_path)).first()
    assert (row.document_name, row.entity_text, row.start_pos) == ("x.txt", "A", 1)


def test_stream(spark, tmp_path):
    texts = [(1, "Entretien avec M. Dubois."), (2, "Mme Petit et M. Dubois."), (3, "Rien.")]
    for k, row in enumerate(texts):
        spark.createDataFrame([row], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        incremental.start(docs, str(tmp_path / "map"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: "Entretien avec M. PER-001.", 2: "Mme PER-002 et M. PER-001.", 3: "Rien."}
    assert incremental.mappings(spark, str(tmp_path / "map")).select(F.count_distinct("full_name")).first()[0] == 2
