"""Reports of issue rows as lines of text: SARIF, JUnit, GraphML, Mermaid, YAML, HTML and plain text; and atomic writes.

A report is a frame with one column ``line`` (and ``nth``, its order) whose body lines are made row by row, so a report of any size is
written by all executors; ``write_lines`` stores it as ordered text parts between one head and one tail. Values are escaped; null
fields are left out or empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import versions

LEVELS = {5: "error", 4: "error", 3: "warning", 2: "note", 1: "note"}


def xml_text(value: Column) -> Column:
    """A value as XML text or attribute; null is empty, and characters that XML 1.0 doesn't allow become U+FFFD."""
    out = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "\ufffd")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def _framed(body: DataFrame, head: str, tail: str) -> DataFrame:
    """Body (nth, line) between a first and a last line."""
    edge = body.sparkSession.createDataFrame([(-1, head), (2**62, tail)], "nth long, line string")
    return edge.unionByName(body.select(F.col("nth").cast("long").alias("nth"), "line"))


def sarif(issues: DataFrame, nth: str, message: str, tool: str = "driftloom") -> DataFrame:
    """A SARIF 2.1.0 log: each body line is one result object, behind a comma if it isn't the first one."""
    level = F.lit("none")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    place = F.when(
        F.col("file").isNotNull(),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))),
    )
    result = F.to_json(F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.struct(F.coalesce(F.col(message).cast("string"), F.lit("")).alias("text")).alias("message"), place.alias("locations")))
    head = '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "%s"}}, "results": [' % tool
    lines = issues.select(F.col(nth).alias("nth"), result.alias("line"))
    first = lines.agg(F.min("nth")).first()[0]
    ahead = F.when((F.col("nth") == F.lit(first)) & (F.row_number().over(Window.partitionBy("nth").orderBy("line")) == 1), "").otherwise(",")
    return _framed(lines.withColumn("line", F.concat(ahead, "line")), head, "]}]}")


def junit(issues: DataFrame, nth: str, message: str, suite: str = "issues") -> DataFrame:
    """A JUnit suite with one failed case for each issue."""
    case = F.concat(
        F.lit('<testcase classname="'), xml_text(F.col("file")), F.lit('" name="'), xml_text(F.concat_ws(":", "kind", F.col("line").cast("string"))), F.lit('"><failure type="'), xml_text(F.col("kind")), F.lit('" message="'),
        xml_text(F.col(message)), F.lit('"/></testcase>'),
    )
    return _framed(issues.select(F.col(nth).alias("nth"), case.alias("line")), f'<?xml version="1.0" encoding="UTF-8"?><testsuite name="{suite}">', "</testsuite>")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, label) and edges (src, dst, weight) as GraphML; nodes come first."""
    n = nodes.select(F.lit(0).alias("nth"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="label">'), xml_text(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(1).alias("nth"), F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"><data key="weight">'), xml_text(F.col("weight")), F.lit("</data></edge>")).alias("line"))
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/>'
        '<key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    )
    return _framed(n.unionByName(e), head, "</graph></graphml>")


def mermaid(chain: DataFrame, nth: str, label: str) -> DataFrame:
    """A chain of events as a Mermaid graph: each row points to the next of the order given by consecutive numbers from 0."""
    name = F.replace(F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit('"'), F.lit("'"))
    line = F.concat(F.lit("    N"), F.col(nth).cast("string"), F.lit('["'), name, F.lit('"]'), F.when(F.col(nth) > 0, F.concat(F.lit("\n    N"), (F.col(nth) - 1).cast("string"), F.lit(" --> N"), F.col(nth).cast("string"))).otherwise(""))
    return _framed(chain.select(F.col(nth).alias("nth"), line.alias("line")), "graph TD", "")


def yaml(rows: DataFrame, nth: str, columns: list[str]) -> DataFrame:
    """A YAML list of mappings; values are JSON scalars, which YAML reads."""
    fields = [F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), F.coalesce(F.get_json_object(F.to_json(F.struct(F.to_json(F.array(F.col(c))).alias("v"))), "$.v"), F.lit("[null]"))) for i, c in enumerate(columns)]
    flat = F.regexp_replace(F.concat_ws("\n", *fields), r"(?m)^([- ] [^:\n]+: )\[(.*)\]$", "$1$2")
    return _framed(rows.select(F.col(nth).alias("nth"), flat.alias("line")), "---", "...")


def html(rows: DataFrame, nth: str, columns: list[str], title: str) -> DataFrame:
    """A table page."""
    cells = F.concat(*[F.concat(F.lit("<td>"), xml_text(F.col(c)), F.lit("</td>")) for c in columns])
    top = "".join(f"<th>{c}</th>" for c in columns)
    head = f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><table><tr>{top}</tr>'
    return _framed(rows.select(F.col(nth).alias("nth"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("line")), head, "</table></body></html>")


def text(issues: DataFrame, nth: str, message: str) -> DataFrame:
    """One plain line for each issue: [severity] kind file:line message."""
    place = F.concat_ws(":", F.coalesce("file", F.lit("<global>")), F.col("line").cast("string"))
    line = F.concat(F.lit("["), F.col("severity").cast("string"), F.lit("] "), F.concat_ws(" ", "kind", place, F.col(message).cast("string")))
    return _framed(issues.select(F.col(nth).alias("nth"), line.alias("line")), "Issues", "")


def write_lines(report: DataFrame, folder: str) -> None:
    """Stores a report as text parts that are in order when read by name."""
    report.repartitionByRange("nth").sortWithinPartitions("nth").select("line").write.mode("overwrite").text(folder)


def replace_dataset(rows: DataFrame, folder: str) -> None:
    """Stores a dataset as the next version of ``folder``; ``dataset`` reads it. Readers see the old one or the whole new one at any
    time, and a crash in between leaves the old one. The version before the old one is removed."""
    spark, held = rows.sparkSession, versions.numbers(rows.sparkSession, folder)
    name = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    versions.commit(spark, folder, held[-1] + 1 if held else 0, {"data": name})
    if len(held) > 1:
        versions.forget(spark, folder, versions.read(spark, folder, held[-2])["data"])


def dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a dataset that ``replace_dataset`` stored."""
    return spark.read.parquet(f"{folder}/{versions.read(spark, folder, versions.numbers(spark, folder)[-1])['data']}")
