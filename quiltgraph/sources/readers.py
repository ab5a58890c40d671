"""Graphs from text, JSON and Parquet.

adj          VID PARTITION SINK*, split at white space
adj_by_file  VID SINK*, the partition from the file's place in the sorted list of files
json         [src, partition, "value", [[sink, edge_id, "value"], ...]]
json_map     [src, "key:type:value$...", [[sink, edge_id, "key:type:value$..."], ...]], the partition from the file
edgelist     SRC DST, lines that begin with # are comments; the partition from the vertex id
tables       vertices.parquet and edges.parquet in a folder

A function in place of a name is a reader of one's own: it gets the lines (line, file) and returns what ``parse`` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltgraph.operators.graph import Graph, build_graph

FORMATS = ("adj", "adj_by_file", "json", "json_map", "edgelist", "tables")
MODES = ("failfast", "permissive")


Parser = Callable[[DataFrame], DataFrame]


def read_graph(spark: SparkSession, path: str | list[str], format: str | Parser = "adj", mode: str = "failfast", undeclared: str = "add", partitions: int = 1, split: bool = True) -> Graph:
    """A graph from files. Blank lines are skipped; a malformed line is an error (failfast) or left out (permissive; see
    ``bad_rows``). A vertex on several lines has the edges of all of them. ``partitions`` is for edge lists only: a
    vertex is in the partition of its id modulo that number. Without ``split``, one task parses all lines of a file."""
    if not callable(format) and format not in FORMATS or mode not in MODES:
        raise ValueError(f"format is one of {', '.join(FORMATS)}; mode one of {', '.join(MODES)}")
    if format == "tables":
        return build_graph(spark.read.parquet(f"{path}/vertices.parquet"), spark.read.parquet(f"{path}/edges.parquet"), undeclared)
    rows = parse(spark, path, format, split)
    if mode == "failfast":
        rows = rows.withColumn("src", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("malformed line: "), F.col("line"))).cast("bigint")).otherwise(F.col("src")))
    else:
        rows = rows.where("not bad")
    if format == "edgelist":
        ends = rows.select(F.explode(F.array("src", F.col("out")[0]["dst"])).alias("vertex_id")).distinct()
        vertices = ends.withColumn("partition_id", F.pmod("vertex_id", F.lit(partitions)).cast("int"))
    else:
        vertices = rows.select(F.col("src").alias("vertex_id"), "partition_id", *[c for c in ("value",) if c in rows.columns])
    out = rows.select("src", F.posexplode("out").alias("position", "e"))
    keys = [f.name for f in out.schema["e"].dataType.fields]
    return build_graph(vertices, out.select("src", *[c for c in ("position",) if "edge_id" not in keys], "e.*"), undeclared)


def bad_rows(spark: SparkSession, path: str | list[str], format: str | Parser) -> DataFrame:
    """The malformed lines that the permissive mode leaves out."""
    return parse(spark, path, format).where("bad").select("line")


def parse(spark: SparkSession, path: str | list[str], format: str | Parser, split: bool = True) -> DataFrame:
    """(line, bad, src, partition_id, value if any, out: array of edges) of each line that isn't blank."""
    text = spark.read.text(path)
    lines = text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    if not split:
        lines = lines.repartition("file")
    if format in ("adj_by_file", "json_map"):
        lines = lines.join(F.broadcast(_file_numbers(text)), "file")
    if callable(format):
        return format(lines)
    return {"adj": _adjacency, "adj_by_file": _adjacency_by_file, "json": _json, "json_map": _json_map, "edgelist": _edges}[format](lines)


def _file_numbers(text: DataFrame) -> DataFrame:
    """(file, partition_id): a row for each file."""
    files = text.select(F.col("_metadata.file_path").alias("file")).distinct()
    return files.withColumn("partition_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))


def _tokens() -> Column:
    return F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _sinks(tokens: str, after: int) -> Column:
    """The tokens after the given number of them, as edges without ids."""
    t = F.col(tokens)
    return F.transform(F.slice(t, F.lit(after + 1), F.greatest(F.size(t) - after, F.lit(0))), lambda x: F.struct(_long(x).alias("dst")))


def _checked(rows: DataFrame, *needed: str) -> DataFrame:
    bad = F.exists("out", lambda e: e["dst"].isNull()) | F.col("out").isNull()
    for c in needed:
        bad = bad | F.col(c).isNull()
    return rows.withColumn("bad", F.coalesce(bad, F.lit(True)))


def _adjacency(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("t", _tokens())
    rows = rows.select("line", _long(F.get("t", F.lit(0))).alias("src"), F.get("t", F.lit(1)).try_cast("int").alias("partition_id"), _sinks("t", 2).alias("out"))
    return _checked(rows, "src", "partition_id")


def _adjacency_by_file(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("t", _tokens())
    return _checked(rows.select("line", _long(F.get("t", F.lit(0))).alias("src"), "partition_id", _sinks("t", 1).alias("out")), "src")


def _edges(lines: DataFrame) -> DataFrame:
    rows = lines.where(~F.ltrim("line").startswith("#")).withColumn("t", _tokens())
    rows = rows.select("line", _long(F.get("t", F.lit(0))).alias("src"), F.lit(0).alias("partition_id"), F.array(F.struct(_long(F.get("t", F.lit(1))).alias("dst"))).alias("out"))
    return _checked(rows, "src")


def _json(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("a", F.from_json("line", "array<string>"))
    out = F.transform(F.from_json(F.get("a", F.lit(3)), "array<array<string>>"), lambda e: F.struct(_long(F.get(e, F.lit(0))).alias("dst"), _long(F.get(e, F.lit(1))).alias("edge_id"), F.get(e, F.lit(2)).alias("value")))
    rows = rows.select("line", _long(F.get("a", F.lit(0))).alias("src"), F.get("a", F.lit(1)).try_cast("int").alias("partition_id"), F.get("a", F.lit(2)).alias("value"), out.alias("out"))
    return _checked(rows, "src", "partition_id")


def properties(text: Column) -> Column:
    """map<string, string> of "key:type:value$...": types are ignored, a value ends at a further colon, the last of equal
    keys wins, blanks in keys stay."""
    entries = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\$"), lambda x: F.split(x, ":")), lambda p: F.size(p) >= 3)
    last = F.filter(entries, lambda p, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later[0] == p[0]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], p[2])))


def _json_map(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("a", F.from_json("line", "array<string>"))
    out = F.transform(F.from_json(F.get("a", F.lit(2)), "array<array<string>>"), lambda e: F.struct(_long(F.get(e, F.lit(0))).alias("dst"), _long(F.get(e, F.lit(1))).alias("edge_id"), properties(F.get(e, F.lit(2))).alias("value")))
    return _checked(rows.select("line", _long(F.get("a", F.lit(0))).alias("src"), "partition_id", properties(F.get("a", F.lit(1))).alias("value"), out.alias("out")), "src")
