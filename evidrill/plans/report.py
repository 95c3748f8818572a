"""Reports and exports: JSON rows, markdown, HTML, GraphML, workbooks."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.functions.columns import evidence_label
from evidrill.sources.wide import write_xlsx

#: Rows that a report on the driver takes at most; the exports of whole tables are written by the executors.
REPORT_ROWS = 100_000


def protein_rows(r: DataFrame) -> DataFrame:
    """Result rows with fold_change, its 95 % limits (where sd_log2fc is there) and the evidence label."""
    out = r.withColumn("fold_change", F.pow(F.lit(2.0), F.col("mean_log2fc"))).withColumn("label", evidence_label(F.col("posterior"), F.col("q")))
    if "sd_log2fc" in r.columns:
        for name, sign in (("fold_lo", -1), ("fold_hi", 1)):
            out = out.withColumn(name, F.pow(F.lit(2.0), F.col("mean_log2fc") + sign * 1.96 * F.col("sd_log2fc")))
    return out


def json_value(x: object) -> object:
    """What JSON can hold: numbers that aren't finite become null."""
    return None if isinstance(x, float) and not math.isfinite(x) else x


def to_json(rows: DataFrame, limit: int = REPORT_ROWS) -> str:
    """The table as a JSON array; more rows than the limit raise."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows; write the table instead")
    return json.dumps([{k: json_value(v) for k, v in r.asDict(recursive=True).items()} for r in got], default=str)


def counts(r: DataFrame) -> dict[str, int]:
    """Proteins, and how many at q <= .05 and q <= .01."""
    row = r.agg(F.count("*").alias("n"), F.count(F.when(F.col("q") <= 0.05, 1)).alias("q05"), F.count(F.when(F.col("q") <= 0.01, 1)).alias("q01")).first()
    return row.asDict()


def methods_text(r: DataFrame, config: dict[str, object]) -> str:
    n = counts(r)
    lines = ["# Methods", "", f"Of {n['n']} proteins, {n['q05']} pass a false-discovery rate of 5 % and {n['q01']} one of 1 %.", "", "| option | value |", "|-|-|"]
    return "\n".join([*lines, *(f"| {k} | {v} |" for k, v in sorted(config.items()))]) + "\n"


def markdown_table(rows: DataFrame, limit: int = 50) -> str:
    got = rows.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in got)]) + "\n"


def network_report(statistics: DataFrame, hubs: DataFrame, communities: DataFrame, warnings: Iterable[str] = ()) -> str:
    parts = ["# Network", "", markdown_table(statistics), "## Hubs", "", markdown_table(hubs), "## Communities", "", markdown_table(communities)]
    notes = [f"* {w}" for w in warnings]
    return "\n".join([*parts, *(["## Warnings", "", *notes] if notes else [])]) + "\n"


def html_report(r: DataFrame, title: str, limit: int = REPORT_ROWS) -> str:
    """A page with the rows as JSON and a table that a few lines of script fill."""
    data = to_json(protein_rows(r), limit).replace("</", "<\\/")
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table id='t'></table>"
        f"<script id='d' type='application/json'>{data}</script><script>const d=JSON.parse(document.getElementById('d').textContent),t=document.getElementById('t');"
        "if(d.length){const k=Object.keys(d[0]);for(const r of [k,...d.map(x=>k.map(c=>x[c]))]){const tr=t.insertRow();for(const v of r)tr.insertCell().textContent=v}}</script></body></html>"
    )


def graphml(nodes: DataFrame, edges: DataFrame, limit: int = REPORT_ROWS) -> str:
    """GraphML text; edges carry their attributes by their own ends."""
    n, e = nodes.limit(limit + 1).collect(), edges.limit(limit + 1).collect()
    if max(len(n), len(e)) > limit:
        raise ValueError(f"more than {limit} nodes or edges; export the tables instead")
    kind = {"bigint": "long", "int": "int", "double": "double", "boolean": "boolean"}
    node_keys = [(c, kind.get(t, "string")) for c, t in nodes.dtypes if c != "protein"]
    edge_keys = [(c, kind.get(t, "string")) for c, t in edges.dtypes if c not in ("source", "target")]
    show = lambda v: str(v).lower() if isinstance(v, bool) else escape(str(v))
    out = ["<?xml version='1.0' encoding='UTF-8'?>", "<graphml xmlns='http://graphml.graphdrawing.org/xmlns'>"]
    out += [f"<key id='{p}{i}' for='{f}' attr.name='{escape(c)}' attr.type='{t}'/>" for p, f, keys in (("n", "node", node_keys), ("e", "edge", edge_keys)) for i, (c, t) in enumerate(keys)]
    out.append("<graph edgedefault='directed'>")
    for r in n:
        out.append(f"<node id='{escape(str(r['protein']))}'>" + "".join(f"<data key='n{i}'>{show(r[c])}</data>" for i, (c, _) in enumerate(node_keys) if r[c] is not None) + "</node>")
    for r in e:
        out.append(f"<edge source='{escape(str(r['source']))}' target='{escape(str(r['target']))}'>" + "".join(f"<data key='e{i}'>{show(r[c])}</data>" for i, (c, _) in enumerate(edge_keys) if r[c] is not None) + "</edge>")
    return "\n".join([*out, "</graph>", "</graphml>"]) + "\n"


def export_tables(path: str, **tables: DataFrame) -> None:
    """Each table as a folder of csv files; arrays and structs as JSON text."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def export_workbook(path: str, limit: int = REPORT_ROWS, **sheets: DataFrame) -> None:
    """A workbook of small tables; a table of more than limit rows raises."""
    found = {name: [list(r) for r in df.limit(limit + 1).collect()] for name, df in sheets.items()}
    if long := [name for name, rows in found.items() if len(rows) > limit]:
        raise ValueError(f"more than {limit} rows: {', '.join(long)}")
    write_xlsx(path, {name: [df.columns, *found[name]] for name, df in sheets.items()})
