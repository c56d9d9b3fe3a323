"""Archives, word files and workbooks as rows: decoding runs in the tasks that hold the bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from datetime import date, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_ENTRIES, MOST_BYTES, MOST_TOTAL, MOST_DEPTH = 2000, 500 << 20, 2 << 30, 3
SKIPPED = (".sign", ".exe", ".dll", ".bat")
BLOCKS = "doc_id string, ord int, type string, text string, level int, table_id string"
CELLS = "doc_id string, table_id string, row int, col int, text string"


def entry_name(info: zipfile.ZipInfo) -> str:
    """SF-52: names without the UTF-8 flag are often GBK."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode("cp437").decode("gbk")
    except UnicodeError:
        return info.filename


def unpack(content: bytes, depth: int = 1, left: list | None = None) -> Iterator[tuple[str, int, bytes]]:
    """SRC-5: name, depth and bytes of the files of an archive and of archives in it, within limits.

    Paths that leave the archive, executables and what goes beyond a limit are passed over; equal
    names get a number.
    """
    left = [MOST_ENTRIES, MOST_TOTAL] if left is None else left
    taken: dict[str, int] = {}
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    for info in archive.infolist():
        name = entry_name(info).replace("\\", "/")
        if info.is_dir() or name.startswith("/") or ".." in name.split("/") or name.lower().endswith(SKIPPED):
            continue
        left[0] -= 1
        left[1] -= info.file_size
        if left[0] < 0 or left[1] < 0:
            return
        if info.file_size > MOST_BYTES:
            continue
        with archive.open(info) as f:
            data = f.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            continue
        if name.lower().endswith(".zip"):
            if depth < MOST_DEPTH:
                yield from unpack(data, depth + 1, left)
            continue
        base = name.rsplit("/", 1)[-1]
        taken[base] = taken.get(base, 0) + 1
        if taken[base] > 1:
            stem, dot, ext = base.rpartition(".")
            base = f"{stem}_{taken[base] - 1}{dot}{ext}" if dot else f"{base}_{taken[base] - 1}"
        yield base, depth, data


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def _first(node, name: str):
    return next((x for x in node.iter() if _local(x.tag) == name), None)


def _said(node) -> str:
    pieces = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n"}
    return "".join(pieces[_local(x.tag)](x) for x in node.iter() if _local(x.tag) in pieces)


def docx_blocks(content: bytes) -> tuple[list[tuple], list[list[list[str]]]]:
    """SRC-7: (type, text, level, table number) in the body's order, and the tables' rows.

    A level comes from a style named Heading n or 标题 n, else from the outline level.
    """
    archive = zipfile.ZipFile(io.BytesIO(content))
    levels: dict[str, int] = {}
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")):
            name, outline = _first(style, "name"), _first(style, "outlineLvl")
            m = re.fullmatch(r"(?:heading|标题)\s*([1-9])", _attribute(name, "val") if name is not None else "", re.IGNORECASE)
            if m or outline is not None:
                levels[_attribute(style, "styleId")] = int(m[1]) if m else int(_attribute(outline, "val")) + 1
    blocks, tables = [], []
    body = _first(ElementTree.fromstring(archive.read("word/document.xml")), "body")
    for node in body if body is not None else ():
        if _local(node.tag) == "p":
            text = _said(node).strip()
            style, outline = _first(node, "pStyle"), _first(node, "outlineLvl")
            level = levels.get(_attribute(style, "val"), 0) if style is not None else 0
            level = level or (int(_attribute(outline, "val")) + 1 if outline is not None else 0)
            if text:
                blocks.append(("heading" if level else "paragraph", text, level, None))
        elif _local(node.tag) == "tbl":
            rows = [[_said(c).strip() for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]
            width = max(map(len, rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in rows]
            blocks.append(("table", "\n".join("\t".join(r) for r in rows[:50]), 0, len(tables)))
            tables.append(rows)
    return blocks, tables


def _date_styles(styles) -> set[str]:
    """The numbers of the cell styles whose format is that of a date."""
    own = {_attribute(x, "numFmtId"): _attribute(x, "formatCode") for x in styles.iter() if _local(x.tag) == "numFmt"}
    is_date = lambda n: n in map(str, (*range(14, 18), 22)) or bool(re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "").lower())))
    formats = next((x for x in styles if _local(x.tag) == "cellXfs"), ())
    return {str(i) for i, x in enumerate(formats) if is_date(_attribute(x, "numFmtId"))}


def xlsx_blocks(content: bytes) -> tuple[list[tuple], list[list[list[str]]]]:
    """SRC-9: a heading and a table for each sheet; blank rows go."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = archive.namelist()
    shared = [_said(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dates = _date_styles(ElementTree.fromstring(archive.read("xl/styles.xml"))) if "xl/styles.xml" in names else ()
    links = {_attribute(x, "Id"): _attribute(x, "Target") for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    blocks, tables = [], []
    for sheet in (x for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
        part = "xl/" + links[_attribute(sheet, "id")].removeprefix("/xl/").removeprefix("xl/")
        rows = []
        for row in (x for x in ElementTree.fromstring(archive.read(part)).iter() if _local(x.tag) == "row"):
            cells: list[str] = []
            for cell in row:
                letters = re.match("[A-Z]*", _attribute(cell, "r"))[0]
                at = 0
                for c in letters:
                    at = at * 26 + ord(c) - 64
                cells += [""] * ((at or len(cells) + 1) - 1 - len(cells))
                value = _first(cell, "v")
                raw = (value.text or "") if value is not None else _said(cell)
                kind = _attribute(cell, "t")
                if kind == "s" and raw.isdigit():
                    raw = shared[int(raw)]
                elif kind in ("", "n") and _attribute(cell, "s") in dates and re.fullmatch(r"\d+(?:\.\d+)?", raw):
                    raw = str(date(1899, 12, 30) + timedelta(int(float(raw))))
                elif kind in ("", "n") and re.fullmatch(r"-?\d+\.0+", raw):
                    raw = raw.split(".")[0]
                cells.append(raw.strip())
            if any(cells):
                rows.append(cells)
        width = max(map(len, rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in rows]
        blocks.append(("heading", _attribute(sheet, "name"), 1, None))
        blocks.append(("table", "\n".join("\t".join(r) for r in rows[:200]), 0, len(tables)))
        tables.append(rows)
    return blocks, tables


#: A parser gives blocks (type, text, level, table number) and the tables' rows.
Parser = Callable[[bytes], tuple[list[tuple], list[list[list[str]]]]]
PARSERS: dict[str, Parser] = {"docx": docx_blocks, "xlsx": xlsx_blocks}


def _rows(found: DataFrame, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(make(row))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return found.mapInArrow(run, schema)


def unpacked(found: DataFrame) -> DataFrame:
    """SRC-5 on rows of path and content: path, name, depth and content of each file inside."""
    return _rows(found.select("path", "content"), "path string, name string, depth int, content binary", lambda r: ((r["path"], *e) for e in unpack(r["content"])))


def blocks(found: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """SRC-7, SRC-9, SRC-14, UX-4, UX-8: blocks of rows of doc_id, route and content.

    parsers has a function for each route. A route without one, such as doc, and a file that cannot
    be read give one block of type failed, with the reason.
    """

    def make(r):
        if r["route"] not in parsers:
            yield r["doc_id"], 0, "failed", f"no parser for {r['route']}", 0, None
            return
        try:
            for k, (kind, text, level, table) in enumerate(parsers[r["route"]](r["content"])[0]):
                yield r["doc_id"], k, kind, text, level, None if table is None else f"t-{table:04d}"
        except Exception as e:  # whatever a parser meets in a file is that file's failure
            yield r["doc_id"], 0, "failed", f"{type(e).__name__}: {e}", 0, None

    return _rows(found.select("doc_id", "route", "content"), BLOCKS, make)


def cells(found: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """D4: cells of the tables of rows of doc_id, route and content, in long form; failed files have none."""

    def make(r):
        try:
            tables = parsers[r["route"]](r["content"])[1]
        except Exception:  # `blocks` tells the reason
            return
        for t, rows in enumerate(tables):
            for i, row in enumerate(rows):
                for j, text in enumerate(row):
                    yield r["doc_id"], f"t-{t:04d}", i, j, text

    return _rows(found.select("doc_id", "route", "content"), CELLS, make)
