"""Readers of the file formats that the pipeline exchanges, with explicit schemas.

Where a line's number is its key, a file is read whole and split; files too large for
that go through ``numbered_lines``, which numbers lines in file order without collecting.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

#: Texts that stand for a missing value, as common CSV readers take them.
NULLS = ("", "NA", "N/A", "null", "NULL", "None", "nan", "NaN")

# Where the JSON-like format lacks a comma, and where it has one too many.
MISSING_COMMA = r"\}\s*(?=\"[^\"]+\"\s*:)"
EXTRA_COMMA = r",\s*([}\]])"


def edge_table(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Edge CSV with header, by column name: (x_index, x_name, relation, y_index, y_name, ord); names may be in any order.

    Missing values are null by :data:`NULLS`; indexes are LONG where they are numbers.
    ``ord`` grows with file order inside and across the pieces of the file.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    clean = {c: F.when(~strip(F.col(c)).isin(*NULLS), F.col(c)) for c in ("x_index", "x_name", "relation", "y_index", "y_name") if c in raw.columns}
    rows = raw.select(*(v.alias(k) for k, v in clean.items()), F.monotonically_increasing_id().alias("ord"))
    rows = rows.withColumns({c: F.col(c).try_cast("double").try_cast("long") for c in ("x_index", "y_index") if c in clean})
    return rows if columns is None else rows.select(*columns)


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a small file; only the empty piece after a final line end is dropped."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    parts = F.split(F.regexp_replace("value", "\n\\z", ""), "\n")
    return text.select(F.posexplode(parts).alias("line_no", "line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a large file, in file order: a number within each piece of the file, and the pieces' sizes."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    rows = rows.select(F.shiftright("id", 33).alias("piece"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"), "line")
    starts, total = [], 0
    for r in sorted(rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r.piece, total))
        total += r.n
    first = spark.createDataFrame(starts, "piece long, first long")
    return rows.join(F.broadcast(first), "piece").select((F.col("first") + F.col("at")).alias("line_no"), "line")


def _lists(lines: DataFrame, items: Column, skip_blank: bool) -> DataFrame:
    if skip_blank:  # later lines move up
        from ..operators.worklist import numbered

        lines = numbered(lines.where(strip(F.col("line")) != ""), [F.col("line_no")], [F.col("line_no")], "entity")
    else:
        lines = lines.withColumn("entity", F.col("line_no").cast("long"))
    return lines.select("entity", items.alias("ids"))


def id_lists(lines: DataFrame, skip_blank: bool = False) -> DataFrame:
    """(entity, ids): comma-separated integers of each line; a blank line is an entity without ids unless skipped."""
    parts = F.filter(F.transform(F.split("line", ","), strip), lambda x: x != "")
    return _lists(lines, F.transform(parts, lambda x: x.cast("int")), skip_blank)


def digit_lists(lines: DataFrame) -> DataFrame:
    """(entity, ids): every run of digits of each line, signs and braces aside."""
    return _lists(lines, F.transform(F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int")), False)


def label_matrix(lines: DataFrame) -> DataFrame:
    """(entity, label_idx, label) of comma-separated 0/1 lines."""
    rows = id_lists(lines)
    return rows.select("entity", F.posexplode("ids").alias("label_idx", "label"))


def indicator_positions(lines: DataFrame) -> DataFrame:
    """(entity, ids): positions of the ones."""
    rows = id_lists(lines)
    ones = F.filter(F.transform("ids", lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    return rows.select("entity", ones.alias("ids"))


def exploded(lists: DataFrame) -> DataFrame:
    """(entity, pos, node_id)."""
    return lists.select("entity", F.posexplode("ids").alias("pos", "node_id"))


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(ord, key, value) of a JSON object file; of repeated keys the last counts."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", f"map<string,{value}>"))
    rows = text.select(F.posexplode(entries).alias("at", "entry")).select("at", "entry.key", "entry.value")
    return rows.groupBy("key").agg(F.min("at").alias("ord"), F.max_by("value", "at").alias("value")).select("ord", "key", "value")


def id_names(spark: SparkSession, path: str) -> DataFrame:
    """(ord, node_id, name) of a JSON object from integer strings to names."""
    return json_map(spark, path).select("ord", F.col("key").try_cast("int").alias("node_id"), F.col("value").alias("name"))


def disease_filter(spark: SparkSession, path: str) -> DataFrame:
    """(disease, alias, kg_index) of a JSON object from names to [alias or null, number]."""
    rows = json_map(spark, path, "array<string>")
    return rows.select(F.col("key").alias("disease"), F.get("value", F.lit(0)).alias("alias"), F.get("value", F.lit(1)).try_cast("double").try_cast("long").alias("kg_index"))


def repaired(text: Column) -> Column:
    """JSON-like text made JSON: outer braces, commas between blocks, none before a closing bracket."""
    t = strip(text)
    t = F.when(t.startswith("{"), t).otherwise(F.concat(F.lit("{\n"), t, F.lit("\n}")))
    t = F.regexp_replace(t, MISSING_COMMA, "},\n")
    return F.regexp_replace(t, EXTRA_COMMA, "$1")


_RELEVANCE = "map<string,map<string,struct<name:string,reason:string>>>"


def relevance(texts: DataFrame, column: str = "value") -> DataFrame:
    """(disease, entity_key, name, reason) of JSON-like text in ``column``; text beyond repair is an error."""
    parsed = F.from_json(repaired(F.col(column)), _RELEVANCE)
    sure = F.when(F.col(column).isNotNull() & parsed.isNull(), F.raise_error(F.lit("relevance text cannot be parsed"))).otherwise(parsed)
    rows = texts.select(F.explode(sure).alias("disease", "block"))
    return rows.select("disease", F.explode("block").alias("entity_key", "entry")).select("disease", "entity_key", "entry.name", "entry.reason")


def relevance_file(spark: SparkSession, path: str) -> DataFrame:
    return relevance(spark.read.text(path, wholetext=True))


def entity_number(key: Column) -> Column:
    """The first digit run of an entity key; without one a large number."""
    return F.coalesce(F.regexp_extract(key, "[0-9]+", 0).try_cast("long"), F.lit(10**9))


def path_lists(spark: SparkSession, path: str) -> DataFrame:
    """(disease, pos, path) of a JSON object from names to path strings."""
    rows = json_map(spark, path, "array<string>")
    return rows.select(F.col("key").alias("disease"), F.posexplode("value").alias("pos", "path"))


def refined_map(lines: DataFrame, file_no: int = 0, quote_mode: str = "strip") -> DataFrame:
    """(query, entity, kg_index, file_no, ord) of lines ``query: [name, index]``; malformed lines are left out.

    The query ends at the first colon, the index follows the last comma. ``quote_mode``
    ``strip`` takes quotes of both kinds off the ends, ``double`` only double ones.
    """
    inner = F.regexp_extract("line", r"(?s)^[^:]*:\s*\[?(.*?)\]?\s*,?\s*\z", 1)
    quotes = "\"'" if quote_mode == "strip" else "\""
    bare = lambda c: F.regexp_replace(strip(c), f"^[{quotes}]+|[{quotes}]+$", "")
    index = strip(F.regexp_extract(inner, r"(?s)^.*,([^,]*)\z", 1)).try_cast("double").try_cast("long")
    rows = lines.where(F.contains(F.col("line"), F.lit(":"))).select(
        bare(F.substring_index("line", ":", 1)).alias("query"), bare(F.regexp_extract(inner, r"(?s)^(.*),[^,]*\z", 1)).alias("entity"),
        index.alias("kg_index"), F.lit(file_no).alias("file_no"), F.col("line_no").cast("long").alias("ord"),
    )
    return rows.where("kg_index IS NOT NULL")


def entity_lines(lines: DataFrame) -> DataFrame:
    """(ord, name, kg_index) of ``name: index`` lines, split at the last colon; others are left out."""
    part = lambda g: strip(F.regexp_extract("line", r"(?s)^(.*):([^:]*)\z", g))
    rows = lines.where(F.contains(F.col("line"), F.lit(":"))).select(F.col("line_no").cast("long").alias("ord"), part(1).alias("name"), part(2).try_cast("double").try_cast("long").alias("kg_index"))
    return rows.where("kg_index IS NOT NULL")


def patients_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; without ``patient_id`` the row number takes its place."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    if "patient_id" in rows.columns:
        return rows
    kind = T.StructType([T.StructField("patient_id", T.LongType()), *rows.schema.fields])
    return spark.createDataFrame(rows.rdd.zipWithIndex().map(lambda r: (r[1], *r[0])), kind)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_array_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(x) of a JSON array with one record a line, as ``sinks.json_array`` and its pieces have it; lines are read apart."""
    line = F.regexp_replace(F.regexp_replace("value", r"^\[", ""), r"[,\]]\z", "")
    return spark.read.text(path).select(line.alias("line")).where("line <> ''").select(F.from_json("line", schema).alias("x"))


def name_list(spark: SparkSession, path: str, allow_empty: bool = True) -> list:
    """A JSON array file, small by nature, as a list; anything else is an error."""
    text = spark.read.text(path, wholetext=True).first()
    got = json.loads(text[0]) if text else None
    if not isinstance(got, list) or not (got or allow_empty):
        raise ValueError(f"{path} must hold a {'' if allow_empty else 'non-empty '}JSON array")
    return got


def prompt_file(spark: SparkSession, path: str) -> str:
    """A text file that replaces the system prompt."""
    return spark.read.text(path, wholetext=True).first()[0]
