"""Archives, word files, workbooks, content lists, sinks and a whole report."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tenderflow.operators import ledger
from tenderflow.plans import report
from tenderflow.sinks import tables
from tenderflow.sources import content_list, entries, files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, rows):
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    body = "".join(f'<w:p><w:pPr>{"<w:pStyle w:val=" + chr(34) + "H1" + chr(34) + "/>" if level else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for level, t in paragraphs)
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", styles)
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}{table}</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = "".join("<row>" + "".join(f'<c r="{"ABC"[j]}{i + 1}"><v>{v}</v></c>' if isinstance(v, float) else f'<c r="{"ABC"[j]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v != "") + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="表一" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_unpack_limits_and_names():
    inner = zipped([("b.txt", b"2")])
    found = list(office.unpack(zipped([("a.txt", b"1"), ("x/a.txt", b"3"), ("../evil.txt", b"!"), ("run.exe", b"!"), ("in.zip", inner), ("bad.zip", b"zip?")])))
    assert found == [("a.txt", 1, b"1"), ("a_1.txt", 1, b"3"), ("b.txt", 2, b"2")]
    assert list(office.unpack(b"not an archive")) == []
    info = zipfile.ZipInfo("招标.docx".encode("gbk").decode("cp437"))
    assert office.entry_name(info) == "招标.docx"


def test_office_blocks_and_cells(spark):
    rows = [("d", "docx", docx([(1, "第一章 公告"), (0, "正文")], [["序号", "名称"], ["1"]])), ("x", "xlsx", xlsx([["名称", "数量"], ["", ""], ["a", 3.0]])), ("bad", "docx", b"??"), ("p", "pdf_text", b"%PDF")]
    found = spark.createDataFrame(rows, "doc_id string, route string, content binary")
    got = {(r.doc_id, r.ord): (r.type, r.level, r.text) for r in office.blocks(found).collect()}
    assert got[("d", 0)] == ("heading", 1, "第一章 公告") and got[("d", 1)] == ("paragraph", 0, "正文") and got[("d", 2)][0] == "table"
    assert got[("x", 0)] == ("heading", 1, "表一") and got[("x", 1)] == ("table", 0, "名称\t数量\na\t3")
    assert got[("bad", 0)][0] == "failed" and got[("p", 0)] == ("failed", 0, "no parser for pdf_text")
    lines = lambda content: ([("paragraph", x, 0, None) for x in content.decode().split("\n")], [])
    own = office.blocks(spark.createDataFrame([("t", "text", b"a\nb"), ("d", "docx", b"")], "doc_id string, route string, content binary"), {"text": lines})
    assert sorted((r.doc_id, r.type, r.text) for r in own.collect()) == [("d", "failed", "no parser for docx"), ("t", "paragraph", "a"), ("t", "paragraph", "b")]
    cells = {(r.doc_id, r.row, r.col): r.text for r in office.cells(found).collect()}
    assert cells[("d", 1, 1)] == "" and cells[("x", 1, 1)] == "3"


def test_dates_of_workbooks():
    book = {n: zipfile.ZipFile(io.BytesIO(xlsx([["日期", 46346.0]]))).read(n) for n in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels")}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book["xl/styles.xml"] = f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="165" formatCode="[Red]0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    book["xl/worksheets/sheet1.xml"] = f"<worksheet {ns}><sheetData><row>{''.join(f'<c s={chr(34)}{s}{chr(34)}><v>46346.5</v></c>' for s in range(4))}</row></sheetData></worksheet>"
    assert office.xlsx_blocks(zipped(book.items()))[1] == [[["46346.5", "2026-11-20", "2026-11-20", "46346.5"]]]


def test_archives_by_entry(spark, tmp_path):
    inner = zipped([("招标.docx", docx([(0, "里")], [])), ("deep.zip", zipped([("x.docx", b"x"), ("deeper.zip", zipped([("y.docx", b"y")]))]))])
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("a/one.docx", docx([(1, "第一章")], [])), ("two.xlsx", xlsx([["a", 1.0]])), ("skip.txt", b"t" * 10_000), ("../evil.docx", b"!"), ("in.zip", inner)):
            z.writestr(name, data)
    torn = bytearray(zipped([("torn.docx", b"content of a file")]))
    torn[40:44] = b"\0\0\0\0"
    for name, data in (("z.zip", packed.getvalue()), ("torn.zip", bytes(torn)), ("none.zip", b"zip?")):
        (tmp_path / name).write_bytes(data)
    archives = files.scan(spark, str(tmp_path), "*.zip")
    found = entries.read(archives, ["docx", "xlsx"])
    got = {r.name: r for r in found.collect()}
    assert set(got) == {"a/one.docx", "two.xlsx", "招标.docx", "x.docx", "torn.docx"}
    assert got["招标.docx"].depth == 2 and got["招标.docx"].path.endswith("z.zip!in.zip") and bytes(got["x.docx"].content) == b"x"
    assert got["torn.docx"].error == "checksum or size differs" and got["torn.docx"].content is None
    assert entries.read(archives).filter("name = 'skip.txt'").first().route == "unsupported"
    made = office.blocks(found.filter("content is not null").select(F.col("name").alias("doc_id"), "route", "content"))
    assert {(r.doc_id, r.text) for r in made.filter("type <> 'failed'").collect()} >= {("a/one.docx", "第一章"), ("招标.docx", "里")}
    many = zipped([(f"{i}.docx", bytes([i]) * 100) for i in range(40)])
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "m.zip").write_bytes(many)
    tasks = entries.cut(files.scan(spark, str(tmp_path / "many"), "*.zip"), 1, None).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_intake(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([(0, "a")], []))
    (tmp_path / "b.docx").write_bytes(bytes.fromhex("D0CF11E0") + b"old")
    (tmp_path / "c.docx").write_bytes(bytes.fromhex("D0CF11E0") + b"old")
    (tmp_path / "d.txt").write_bytes(b"no")
    got = {r.file_name: r.route for r in files.intake(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "docx", "b.docx": "doc"}
    (tmp_path / "z.zip").write_bytes(zipped([("a.docx", b"1")]))
    assert [(r.name, r.depth) for r in office.unpacked(files.scan(spark, str(tmp_path), "*.zip")).collect()] == [("a.docx", 1)]


def test_content_list(spark):
    items = [{"type": "title", "text": "标题", "page_idx": 0}, {"type": "text", "text": "正文", "page_idx": 1}, {"type": "table", "table_body": "<table><tr><td>a</td><td>b</td></tr></table>", "page_idx": 1}]
    found = content_list.blocks(spark.createDataFrame([("d", json.dumps(items))], "doc_id string, json string"))
    assert [(r.type, r.level, r.page_no) for r in found.orderBy("ord").collect()] == [("heading", 1, 1), ("paragraph", 0, 2), ("table", 0, 2)]
    assert [r.text for r in content_list.cells(found).orderBy("col").collect()] == ["a", "b"]
    parts = spark.createDataFrame([("a.docx", "aGk="), ("b.exe", "aGk="), ("c.pdf", "?")], "name string, data string")
    assert [(r.name, bytes(r.content)) for r in content_list.files_of_parts(parts).collect()] == [("a.docx", b"hi")]


def test_report(spark):
    said = [(1, "第一章 招标公告"), (0, "项目名称：东河大桥工程。最高投标限价：3,500.5万元。"), (0, "投标截止时间：2026年11月20日09时30分，联系人：李明，电话：010-12345678"), (1, "第二章 评标办法"), (0, "★投标人须近5年内完成类似业绩3项，附合同。"), (0, "最高限价：3,600万元")]
    blocks = spark.createDataFrame([("d", i, level, t) for i, (level, t) in enumerate(said)], "doc_id string, ord int, level int, text string")
    rows = [["序号", "评分项", "分值", "评分标准"], ["技术标（60分）", "", "", ""], ["1", "方案", "40分", "每项得2分"], ["2", "进度", "20分", "优"], ["商务标（30分）", "", "", ""], ["3", "业绩", "25分", "x"]]
    cells = spark.createDataFrame([("d", "t-0001", i, r) for i, r in enumerate(rows)], "doc_id string, table_id string, row int, cells array<string>")
    out = report.analyse(blocks, cells, as_of=F.lit("2026-06-01").cast("date"))
    fields = {r.field_key: r.value_normalized for r in out["fields"].collect()}
    assert fields == {"project_name": "东河大桥工程", "price_limit": "35005000", "bid_deadline": "2026-11-20 09:30", "contact_phone": "010-12345678"}
    assert [r.field_key for r in out["conflicts"].collect()] == ["price_limit"]
    assert {(r.category, r.state) for r in out["score_checks"].collect()} == {("technical", "passed"), ("commercial", "failed")}
    assert [(r.name, r.score_id) for r in out["scores"].orderBy("row").collect()] == [("方案", "T-001"), ("进度", "T-002"), ("业绩", "C-001")]
    assert {r.zone for r in out["zones"].collect()} == {"notice", "evaluation_method"}
    stats = out["statistics"].first()
    assert (stats.blocks, stats.tables, stats.fields_found, stats.score_items, stats.star_clauses, stats.fields_total) == (6, 1, 4, 3, 1, 31)
    assert stats.requirements == out["requirements"].count() > 0
    assert out["performances"].first().p.years == 5 and out["star_clauses"].first().clause_id == "STAR-01"
    text = "\n".join(t for _, t in said)
    assert all(text[r.char_start : r.char_end] == r.text for r in out["blocks"].collect())
    sheets = tables.workbook(out["fields"], out["fields"].selectExpr("doc_id", "'包1' lot", "field_key", "value_normalized value"), out["fields"].selectExpr("doc_id", "'包01' target_lot").distinct(), out["performances"], out["sections"], out["star_clauses"], out["scores"], ["price_limit"])
    assert sheets["lots"].first().price_limit == "3500.5" and sheets["lots"].first().is_target
    assert len(sheets) == 9


def test_font_levels(spark):
    rows = spark.createDataFrame([("d", 0, 20.0, "Title"), ("d", 1, 16.0, "Sub"), ("d", 2, 10.0, "body " * 60), ("d", 3, 16.0, "long " * 30)], "doc_id string, ord int, size double, text string")
    assert [r.level for r in ledger.font_levels(rows).orderBy("ord").select("level").collect()] == [1, 2, 0, 0]


def test_failed_pages(spark):
    assert ledger.pages_failed(spark.createDataFrame([("d", 3)], "doc_id string, n_pages int")).filter(F.col("status") == "FAILED_REVIEW").count() == 3
