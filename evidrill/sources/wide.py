"""Wide intensity files and their long form."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row a column of a file: which cell of the design its values are. col_index counts from 1.
LAYOUT = T.StructType([T.StructField("protocol", T.IntegerType()), T.StructField("experiment", T.IntegerType()), T.StructField("sample_type", T.StringType()), T.StructField("replicate", T.IntegerType()), T.StructField("col_index", T.IntegerType())])

_XL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_wide(spark: SparkSession, path: str, sheet: str = "Sheet1", name_col: int = 1) -> DataFrame:
    """A csv, parquet or xlsx file, one row a protein, all columns but the name's as doubles. Other endings raise."""
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
    elif path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif path.endswith(".xlsx"):
        header, *rows = read_xlsx(path, sheet)
        schema = T.StructType([T.StructField(str(h), T.StringType()) for h in header])
        raw = spark.createDataFrame([tuple(None if x is None else str(x) for x in [*r, *[None] * (len(header) - len(r))]) for r in rows], schema)
    else:
        raise ValueError(f"neither .csv, .parquet nor .xlsx: {path}")
    return raw.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c) if i + 1 == name_col else F.expr(f"try_cast(`{c}` as double)").alias(c) for i, c in enumerate(raw.columns)])


def to_long(wide: DataFrame, layout: Sequence[tuple[int, int, str, int, int]], name_col: int = 1) -> DataFrame:
    """(protocol, experiment, protein, sample_type, replicate, value): the layout's columns as rows.

    Samples and controls must have the same experiments. One scan: the cells of a row become an array of structs.
    """
    arms = {a: {(p, e) for p, e, kind, _, _ in layout if kind == a} for a in ("Sample", "Control")}
    if arms["Sample"] != arms["Control"]:
        raise ValueError("samples and controls have different experiments")
    cells = [F.struct(F.lit(p).alias("protocol"), F.lit(e).alias("experiment"), F.lit(kind).alias("sample_type"), F.lit(r).alias("replicate"), F.col(f"`{wide.columns[i - 1]}`").alias("value")) for p, e, kind, r, i in layout]
    rows = wide.select(F.col(f"`{wide.columns[name_col - 1]}`").alias("protein"), F.explode(F.array(*cells)).alias("c"))
    return rows.select("c.protocol", "c.experiment", "protein", "c.sample_type", "c.replicate", "c.value")


def layout_from(protocol: int, samples: dict[int, Sequence[int]], controls: dict[int, Sequence[int]]) -> list[tuple[int, int, str, int, int]]:
    """Layout rows of one file from its column numbers by experiment."""
    out = []
    for kind, columns in (("Sample", samples), ("Control", controls)):
        for e, numbers in sorted(columns.items()):
            out += [(protocol, e, kind, r, i) for r, i in enumerate(numbers, 1)]
    return out


def load(spark: SparkSession, files: Sequence[str], samples: Sequence[dict[int, Sequence[int]]], controls: Sequence[dict[int, Sequence[int]]], normalise: bool = False, bait: str | None = None) -> DataFrame:
    """The long table of several files, one protocol a file. Proteins are matched by id; a file that lacks one has no rows of it. Repeated
    ids within a file raise. A bait must be there."""
    from evidrill.operators.prep import normalized

    out = None
    for protocol, (path, s, c) in enumerate(zip(files, samples, controls, strict=True), 1):
        wide = read_wide(spark, path)
        name = wide.columns[0]
        if wide.groupBy(f"`{name}`").count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated ids in {path}")
        one = to_long(wide, layout_from(protocol, s, c))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no files")
    if bait is not None and out.where(F.col("protein") == bait).isEmpty():
        raise ValueError(f"no such bait: {bait}")
    return normalized(out) if normalise else out


def read_xlsx(path: str, sheet: str = "Sheet1") -> list[list[object]]:
    """The rows of a sheet (files of a study are small; they are read on the driver)."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_XL}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_XL}si")]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        names = [s.get("name") for s in book.iter(f"{_XL}sheet")]
        if sheet not in names:
            raise ValueError(f"no such sheet: {sheet}")
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml"))
    rows = []
    for r in root.iter(f"{_XL}row"):
        cells: list[object] = []
        for c in r.iter(f"{_XL}c"):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = 0
            for ch in letters[0] if letters else "":
                at = at * 26 + ord(ch) - 64
            while letters and len(cells) < at - 1:
                cells.append(None)
            v = c.find(f"{_XL}v")
            if c.get("t") == "s":
                cells.append(shared[int(v.text)])
            elif c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{_XL}t")))
            else:
                cells.append(None if v is None or v.text is None else v.text if c.get("t") == "str" else float(v.text))
        rows.append(cells)
    return rows


def _cell(row: int, column: int, value: object) -> str:
    letters, n = "", column
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(65 + r) + letters
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) != float("inf"):
        return f'<c r="{letters}{row}"><v>{value!r}</v></c>'
    return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_xlsx(path: str, sheets: dict[str, Iterable[Sequence[object]]]) -> None:
    """A workbook of the sheets' rows (reports: small tables on the driver)."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{k}">' + "".join(_cell(k, j, v) for j, v in enumerate(r, 1)) + "</row>" for k, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
