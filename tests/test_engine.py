"""Whole runs over folders, with a store."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark.functions import lookup
from veilspark.operators import spans
from veilspark.operators import store as M
from veilspark.plans import engine as X
from veilspark.sources import cells, file_sink, files, tables


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Entretien avec M. Luc Dubois à Paris.\n")
    (tmp_path / "in" / "b.txt").write_text("M. Luc Dubois et Mme Anne Petit.\n")
    (tmp_path / "in" / "bad.docx").write_bytes(b"x")
    return tmp_path


def _texts(path):
    return {p.name: p.read_text() for p in path.iterdir()}


def _all_bytes(*folders):
    return b"".join(p.read_bytes() for f in folders for p in Path(f).rglob("*") if p.is_file() and p.suffix != ".crc")


def test_folder(spark, folder):
    keep = X.ParquetStore(spark, str(folder / "db"), "a long passphrase", 10)
    out = {r.path.rsplit("/", 1)[-1]: r for r in X.process_folder(spark, str(folder / "in"), str(folder / "out"), keep).collect()}
    assert out["bad.docx"].error and out["bad.docx"].output is None and out["a.txt"].n_replaced == 2
    texts = _texts(folder / "out")
    found = {r.full_name: r.pseudonym_full for r in keep.mappings().collect()}
    assert set(found) == {"Luc Dubois", "Paris", "Anne Petit"}
    assert texts["a_pseudonymized.txt"] == f"Entretien avec M. {found['Luc Dubois']} à {found['Paris']}.\n"
    assert texts["b_pseudonymized.txt"] == f"M. {found['Luc Dubois']} et Mme {found['Anne Petit']}.\n"
    with pytest.raises(PermissionError):
        X.ParquetStore(spark, str(folder / "db"), "another passphrase", 10)
    with pytest.raises(PermissionError):
        X.ParquetStore(spark, str(folder / "db"))
    again = X.ParquetStore(spark, str(folder / "db"), "a long passphrase", 10)
    X.process_folder(spark, str(folder / "in"), str(folder / "out2"), again)
    assert again.mappings().count() == 3 and _texts(folder / "out2") == texts
    row = again.erase("Anne Petit").first()
    assert row.operation_type == "ERASURE" and again.mappings().count() == 2
    assert again.erase("Luc Dubois").first() and again.mappings().count() == 1
    assert sorted(r.operation_type for r in again.operations().collect()) == ["ERASURE", "ERASURE", "PROCESS", "PROCESS"]


def test_nothing_gives_an_erased_name_back(spark, tmp_path, monkeypatch):
    """Neither the store nor the work folder holds the name, a plain hash of it, or the key of what was deleted."""
    work = str(tmp_path / "work")
    monkeypatch.setattr(tables, "work_folder", lambda spark: work)
    keep = X.ParquetStore(spark, str(tmp_path / "db"), "a long passphrase", 10)
    docs = spark.createDataFrame([(1, "Voir M. Luc Dubois et Mme Anne Petit.")], "doc_id long, text string")
    for assigner, theme in ((X.neutral, "neutral_id"), (X.themed(lookup.made_up_library(), "s"), "plain")):
        tables.dropped(X.process(docs, keep, assigner=assigner, theme=theme))
    key = keep.version()[1]["key"]
    keep.erase("Luc Dubois")
    assert [r.full_name for r in keep.mappings().collect()] == ["Anne Petit"]
    held = _all_bytes(work, tmp_path / "db")
    plain = [hashlib.sha256(x.encode()).hexdigest()[:32].encode() for x in ("Luc Dubois", "PERSON|Luc Dubois")]
    assert not any(x in held for x in (b"Dubois", key.encode(), *plain))
    keep.destroy()
    assert b'"key": null' in _all_bytes(tmp_path / "db" / "versions") and not list((tmp_path / "db" / "mappings").iterdir())
    with pytest.raises(PermissionError):
        X.ParquetStore(spark, str(tmp_path / "db"), "a long passphrase", 10)


def test_writers_that_interleave_lose_nothing(spark, tmp_path, monkeypatch):
    a, b = (X.ParquetStore(spark, str(tmp_path / "db"), "a long passphrase", 10) for _ in range(2))
    docs = lambda *names: spark.createDataFrame([(k, f"Voir M. {n}.") for k, n in enumerate(names)], "doc_id long, text string")
    publish, late = X.ParquetStore._publish, []

    def overtaken(self, n, content):
        if self is a and not late:  # another run comes between this one's reading and its commit
            late.append(1)
            X.process(docs("Luc Dubois", "Jean Moreau"), b).count()
        publish(self, n, content)

    monkeypatch.setattr(X.ParquetStore, "_publish", overtaken)
    out = X.process(docs("Luc Dubois", "Anne Petit"), a)
    found = {r.full_name: r.pseudonym_full for r in a.mappings().collect()}
    assert set(found) == {"Luc Dubois", "Jean Moreau", "Anne Petit"} and len(set(found.values())) == 3
    assert [r.text for r in out.orderBy("doc_id").collect()] == [f"Voir M. {found['Luc Dubois']}.", f"Voir M. {found['Anne Petit']}."]
    assert a.operations().count() == 2
    late.clear()
    monkeypatch.setattr(X.ParquetStore, "_publish", lambda self, n, c: (late or (late.append(1), b.erase("Jean Moreau"))) and publish(self, n, c))
    X.process(docs("Claire Durand"), a).count()
    assert {r.full_name for r in b.mappings().collect()} == {"Luc Dubois", "Anne Petit", "Claire Durand"} and a.operations().count() == 4
    assert len([p for p in (tmp_path / "db" / "mappings").iterdir() if not p.name.startswith(".")]) == len(b.version()[1]["mappings"])


def test_a_run_reads_the_buckets_of_its_names(spark, tmp_path):
    keep = X.ParquetStore(spark, str(tmp_path / "db"), "a long passphrase", 10)
    rows = [(f"Prénom{k} Nom{k % 7}", f"Prénom{k}", f"Nom{k % 7}", "PERSON", f"PER-{k:03d}") for k in range(300)]
    keep.add(spark.createDataFrame(rows, "full_name string, first_name string, last_name string, entity_type string, pseudonym_full string"))
    found = keep.lookup(spark.createDataFrame([("Prénom5 Nom5",), ("Nom3",), ("niemand",)], "value string"))
    assert {r.full_name for r in found.collect()} == {"Prénom5 Nom5", *(r[0] for r in rows if r[2] == "Nom3")}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {(r.entity_type, r.base) for r in keep.numbers().collect()} == {("PERSON", 299)}
    assert {r.full_name: r.pseudonym_full for r in keep.mappings().collect()} == {r[0]: r[4] for r in rows}


def test_a_failure_is_logged_without_names(spark, tmp_path):
    keep = X.ParquetStore(spark, str(tmp_path / "db"))
    docs = spark.createDataFrame([(1, "Voir M. Luc Dubois.")], "doc_id long, text string")

    def broken(docs):
        raise ValueError("cannot read 'Luc Dubois' of Anne Petit")

    with pytest.raises(ValueError):
        X.process(docs, keep, detector=broken)
    row = keep.operations().first()
    assert row.success is False and row.error_message.startswith("ValueError") and "Dubois" not in row.error_message and "Petit" not in row.error_message


def _book(path, sheets):
    path.write_bytes(cells.xlsx_bytes(sheets))


def test_tables_keep_their_format_and_share_the_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    book = [("Gens", {(1, 1): "Nom", (2, 1): "M. Luc Dubois", (2, 3): "voit Mme Anne Petit", (9, 2): "12"}), ("Vide", {}), ("Notes", {(1, 2): "Dubois est à Paris"})]
    _book(tmp_path / "in" / "livre.xlsx", book)
    (tmp_path / "in" / "t.csv").write_text('a;b\n"M. Luc Dubois";x\n\nMme Anne Petit;"y;z"\n')
    (tmp_path / "in" / "n.txt").write_text("M. Luc Dubois et M. Hugo Durand")
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"no workbook")
    keep = X.ParquetStore(spark, str(tmp_path / "db"))
    told = {r.path.rsplit("/", 1)[-1]: r for r in X.process_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), keep).collect()}
    name = {r.full_name: r.pseudonym_full for r in keep.mappings().collect()}
    assert told["bad.xlsx"].error and told["livre.xlsx"].n_replaced == 3 and told["t.csv"].output == "t_pseudonymized.csv"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["livre_pseudonymized.xlsx", "n_pseudonymized.txt", "t_pseudonymized.csv"]
    luc, anne = name["Luc Dubois"], name["Anne Petit"]
    back = files.xlsx_sheets((tmp_path / "out" / "livre_pseudonymized.xlsx").read_bytes())
    assert [n for n, _ in back] == ["Gens", "Vide", "Notes"] and back[1][1] == {}
    assert back[0][1] == {(1, 1): "Nom", (2, 1): f"M. {luc}", (2, 3): f"voit Mme {anne}", (9, 2): "12"}
    assert back[2][1][(1, 2)].endswith(name["Paris"])
    assert (tmp_path / "out" / "t_pseudonymized.csv").read_text().splitlines() == ["a,b", f"M. {luc},x", ",", f"Mme {anne},y;z"]
    assert (tmp_path / "out" / "n_pseudonymized.txt").read_text() == f"M. {luc} et M. {name['Hugo Durand']}"


def test_decisions_reach_texts_mappings_and_log(spark, tmp_path):
    keep = X.ParquetStore(spark, str(tmp_path / "db"))
    text = "Voir M. Luc Dubois, Mme Anne Petit, Dr. Hugo Durand et M. Jean Moreau au dossier Azur."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    shown = {r.text: r.span_id for r in X.preview(docs).collect()}
    rows = [
        (1, shown["M. Luc Dubois"], 1, "CONFIRM", None, None, None, None, None),
        (1, shown["Mme Anne Petit"], 1, "REJECT", None, None, None, None, None),
        (1, shown["Dr. Hugo Durand"], 1, "MODIFY", "Dr. Hugo Durant", None, None, None, None),
        (1, shown["M. Jean Moreau"], 1, "CHANGE_PSEUDONYM", None, "Monsieur X", None, None, None),
        (1, "by hand", 1, "ADD", "Azur", None, "ORG", None, None),
        (1, "nowhere", 1, "ADD", "Nirgends", None, "ORG", None, None),
    ]
    decisions = spark.createDataFrame(rows, "doc_id long, span_id string, seq int, action string, new_text string, new_pseudonym string, entity_type string, start_pos int, end_pos int")
    first = X.process(docs, keep, decisions=decisions).first().text
    name = {r.full_name: r.pseudonym_full for r in keep.mappings().collect()}
    assert set(name) == {"Luc Dubois", "Hugo Durant", "Jean Moreau", "Azur"} and name["Jean Moreau"] == "Monsieur X"
    assert first == f"Voir M. {name['Luc Dubois']}, Mme Anne Petit, Dr. {name['Hugo Durant']} et M. Monsieur X au dossier {name['Azur']}."
    assert X.process(docs, keep, decisions=decisions).first().text == first
    assert {r.full_name: r.pseudonym_full for r in keep.mappings().collect()} == name
    log = keep.operations().collect()
    assert len(log) == 2 and log[0].user_modifications == {"CONFIRM": "1", "REJECT": "1", "MODIFY": "1", "CHANGE_PSEUDONYM": "1", "ADD": "2"}


def test_sink_leaves_nothing_of_a_failed_job(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    bad = rows.withColumn("content", F.when(F.col("name") == "d/13.txt", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        file_sink.write_files(bad.repartition(5), str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    file_sink.write_files(rows.repartition(5), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out" / "d").iterdir()} == {f"{k}.txt": str(k) for k in range(20)}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["d"]
    with pytest.raises(ValueError):
        file_sink.checked("../x")


def test_equal_and_odd_names_keep_files_of_their_own(spark, tmp_path):
    for name in ("x/a.txt", "y/a.txt", "é.txt", "è.txt", "e f.txt", "50%.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(f"text of {name}\n")
    keep = X.ParquetStore(spark, str(tmp_path / "db"))
    out = X.process_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), keep, recursive=True).collect()
    assert sorted(r.output for r in out) == sorted(["x/a_pseudonymized.txt", "y/a_pseudonymized.txt", "é_pseudonymized.txt", "è_pseudonymized.txt", "e f_pseudonymized.txt", "50%_pseudonymized.txt"])
    for r in out:
        assert (tmp_path / "out" / r.output).read_text() == f"text of {r.output.replace('_pseudonymized', '')}\n"


def test_a_batch_that_is_run_again_writes_once(spark, tmp_path):
    from veilspark.streaming import incremental

    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    for k in (0, 1, 1):
        docs = spark.createDataFrame([(k, f"Voir M. Luc Dubois et Mme Anne Petit{k}.")], "doc_id long, text string")
        incremental.one_batch(docs, store, out, k)
    names = [r.full_name for r in incremental.mappings(spark, store).collect()]
    assert len(names) == len(set(names)) and "Luc Dubois" in names
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [0, 1]


def test_preview_and_themes(spark):
    docs = spark.createDataFrame([(1, "Voir M. Luc Dubois."), (2, "Voir Dr. Anne Petit à Lyon.")], "doc_id long, text string")
    assert {r.preview for r in X.preview(docs).collect()} == {"M. PER-001", "Dr. PER-002", "LOC-001"}
    library = lookup.made_up_library()
    shown = {r.text: r.preview for r in X.preview(docs, assigner=X.themed(library, "s")).collect()}
    assert shown["M. Luc Dubois"].split()[1] in library["first_names"]["male"]


def test_settings():
    found = X.settings(("home", {"theme": "star", "recursive": None}), ("command line", {"theme": "plain"}))
    assert found["theme"] == ("plain", "command line") and found["recursive"] == (False, "default")
    with pytest.raises(ValueError):
        X.settings(("file", {"passphrase": "x"}))


def test_log_names_the_detector_and_steps_are_told(spark, folder):
    keep, told = X.ParquetStore(spark, str(folder / "db2")), []
    docs = spark.createDataFrame([(1, "Voir M. Luc Dubois.")], "doc_id long, text string")
    X.process(docs, keep, notify=told.append)
    row = keep.operations().collect()[0]
    assert (row.model_name, row.model_version) == ("patterns", "1.0")
    assert told == ["2 spans found", "mappings stored"]  # with the title and without
    assert spans.detector_info(lambda d: d) == {"name": "<lambda>"}
    assert {r.measure: r.n for r in M.consistency(keep.mappings(), keep.operations()).collect()} == {
        "mappings": 1, "shared_pseudonyms": 0, "shared_names": 0, "operations": 1, "succeeded": 1, "failed": 0,
    }
