"""Worksheets (.xlsx) as a batch data source, reader and writer, from the standard library alone.

``spark.dataSource.register(XlsxSource)`` and then ``spark.read.format("xlsx").load(path)``. All columns are
strings, named by the first row's cells in their own places; fully blank rows are dropped; ``row_id`` is the
row's place in its file (and ``archivo`` the file). A cell with a link gives it in a column ``<name>__url``
when the option ``links`` names that column. A workbook is one task: the format can't be split. The writer
makes one workbook a partition.
"""

from __future__ import annotations

import glob
import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_FORMULA = re.compile(r'HYPERLINK\("([^"]+)"')


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(path: str) -> Iterator[dict[int, tuple[str | None, str | None]]]:
    """The first sheet's rows: column number to (value, link)."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in E.parse(z.open("xl/sharedStrings.xml")).getroot()] if "xl/sharedStrings.xml" in names else []
        sheet = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))[0]
        rels = f"xl/worksheets/_rels/{os.path.basename(sheet)}.rels"
        targets = {r.get("Id"): r.get("Target") for r in E.parse(z.open(rels)).getroot()} if rels in names else {}
        links: dict[str, str] = {}
        if targets:  # links stand behind the rows
            for _, e in E.iterparse(z.open(sheet)):
                if e.tag == f"{_M}hyperlink":
                    links[e.get("ref")] = targets.get(e.get(f"{_R}id"))
                elif e.tag == f"{_M}row":
                    e.clear()
        for _, row in E.iterparse(z.open(sheet)):
            if row.tag != f"{_M}row":
                continue
            out: dict[int, tuple[str | None, str | None]] = {}
            for k, c in enumerate(row.findall(f"{_M}c")):
                ref, kind = c.get("r") or "", c.get("t")
                v, f = c.find(f"{_M}v"), c.find(f"{_M}f")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif v is None:
                    text = None
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                m = _FORMULA.search(f.text or "") if f is not None else None
                url = links.get(ref) or (m.group(1) if m else None)
                if text is not None or url:
                    out[_column(ref) if ref else k] = (text, url)
            yield out
            row.clear()


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _files(self) -> list[str]:
        path = self.options["path"]
        return sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else [path]

    def _links(self) -> list[str]:
        return [x for x in self.options.get("links", "").split(",") if x]

    def schema(self) -> StructType:
        head = next(rows(self._files()[0]), {})
        names = [own(v[0]) for _, v in sorted(head.items()) if v[0]]
        extra = [StructField(f"{n}__url", StringType()) for n in self._links()]
        return StructType([StructField("row_id", LongType()), StructField("archivo", StringType()), *[StructField(n, StringType()) for n in names], *extra])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self._files(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(self.options["path"], schema, overwrite, self.options.get("sheet", "Resultado"))


def own(name: str) -> str:
    """A sheet's column name; one that the source adds itself gets ``_hoja`` behind it."""
    return f"{name}_hoja" if name in ("row_id", "archivo") else name


class XlsxReader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType):
        self.files, self.names = files, schema.names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        it = rows(partition.value)
        head = {own(v[0]): k for k, v in next(it, {}).items() if v[0]}
        for i, row in enumerate(it, 1):
            if row:
                cell = lambda n: row.get(head.get(n, -1), (None, None))  # noqa: B023, E731
                yield (i, os.path.basename(partition.value), *[cell(n[:-5])[1] if n.endswith("__url") else cell(n)[0] for n in self.names[2:]])


class XlsxWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, sheet: str = "Resultado"):
        self.path, self.names, self.sheet = path, schema.names, sheet
        if overwrite and os.path.isdir(path):
            for f in glob.glob(os.path.join(path, "*.xlsx")):
                os.remove(f)
        os.makedirs(path, exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        data = [self.names]
        data += [list(r) for r in iterator]
        if len(data) > 1:
            with open(os.path.join(self.path, f"part-{uuid.uuid4().hex}.xlsx"), "wb") as f:
                f.write(workbook(data, self.sheet))
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


def workbook(data: list[list], sheet: str = "Resultado") -> bytes:
    """A workbook of one sheet: numbers as numbers, (text, url) pairs as links, other values as text."""
    body, links, rels = [], [], []
    for i, row in enumerate(data, 1):
        cells = []
        for k, v in enumerate(row):
            ref, n = "", k
            while n >= 0:
                ref, n = chr(65 + n % 26) + ref, n // 26 - 1
            if isinstance(v, (tuple, dict)) and len(v) == 2:
                v, url = tuple(v.values()) if isinstance(v, dict) else v
                if url:
                    rels.append(f'<Relationship Id="r{len(rels) + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target={quoteattr(url)} TargetMode="External"/>')
                    links.append(f'<hyperlink ref="{ref}{i}" r:id="r{len(rels)}"/>')
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{ref}{i}"><v>{v}</v></c>')
            else:
                text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(v))
                cells.append(f'<c r="{ref}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{doc}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        tail = f"<hyperlinks>{''.join(links)}</hyperlinks>" if links else ""
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}" xmlns:r="{doc}"><sheetData>{"".join(body)}</sheetData>{tail}</worksheet>')
        if rels:
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">{"".join(rels)}</Relationships>')
    return out.getvalue()
