"""Workbooks without a spreadsheet library."""

import zipfile

from tessera.operators import evidence as etl
from tessera.sources import readers, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="BOQ" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Amount (INR)</t></si><si><r><t>De</t></r><r><t>tails</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1000</v></c><c r="B2" t="inlineStr"><is><t>pipes</t></is></c><c r="C2"/></row><row r="3"><c r="A3"><f>SUM(A2:A2)</f><v>1000</v></c></row></sheetData></worksheet>')


def test_workbooks_become_facts(spark, tmp_path):
    make(tmp_path / "w.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    documents, failures = workbook.extract(readers.files(spark, str(tmp_path)))
    cells = {c.cell_address: (c.value, c.formula) for c in documents.first().sheets[0].cells}
    assert cells == {"A1": ("Amount (INR)", None), "B1": ("Details", None), "A2": ("1000", None), "B2": ("pipes", None), "A3": ("=SUM(A2:A2)", "=SUM(A2:A2)")}
    assert sorted(r.document_id for r in failures.collect()) == ["bad", "x"]
    facts = etl.build_facts(etl.build_evidence(documents)).collect()
    assert {(r.predicate, r.raw_value) for r in facts} == {("amount", "1000"), ("description", "pipes"), ("computed_value", "=SUM(A2:A2)")}


def test_files_are_taken_in_by_one_command(spark, tmp_path):
    from tessera.engine import Engine

    (tmp_path / "in").mkdir()
    make(tmp_path / "in" / "w.xlsx")
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"not a zip")
    engine = Engine.ingest(spark, str(tmp_path / "in"), str(tmp_path / "world"))
    assert engine.world.facts.count() == 3
    report = spark.read.json(str(tmp_path / "world" / "report")).first()
    assert (report.documents_processed, report.facts_created, report.documents_failed) == (1, 3, 1)
    assert engine.refresh_index() > 0 and engine.refresh_index() == 0
    assert engine.get_coverage().first().vectors > 0
    again = Engine.ingest(spark, str(tmp_path / "in"), str(tmp_path / "world"))
    assert again.world.facts.count() == 3
