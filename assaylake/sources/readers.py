"""Readers for delimited, JSON, group-definition and report text files."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.text import coerce_numeric_text, strip_all
from assaylake.operators.clean import MISSING_TOKENS, tokens_to_null
from assaylake.session import new_path
from assaylake.sources.ranges import Brackets, Delimited, records

ENCODINGS = ("utf-8", "latin1", "cp1252", "iso-8859-1")  # fixed values, tried in this order


SINGLE_BYTE = {"UTF-8": None, "US-ASCII": None, "ISO-8859-1": "ISO-8859-1", "WINDOWS-1252": "windows-1252"}  # encodings in which quotes and breaks are plain bytes


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = True, split: bool = True
) -> DataFrame:
    """Delimited text with a header; quoted fields may hold separators, line breaks and doubled quotes.

    Files of any size are read range by range (``ranges``), also where quoted
    fields hold line breaks; quotes must then be used as RFC 4180 has them. With
    ``split=False`` Spark's own parser reads each file in one task, with
    ``multi_line=False`` it splits files at all line breaks. Give a schema where
    one is known: inference reads the data once more.
    """
    if not (multi_line and split and encoding.upper() in SINGLE_BYTE):
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"')
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return tokens_to_null(reader.csv(path))
    found = records(spark, path, Delimited(), closing=False)
    charset = SINGLE_BYTE[encoding.upper()]
    text = F.decode("record", charset) if charset else F.col("record").cast("string")
    rows = found.select("first", F.regexp_replace(text, r"\r\z", "").alias("text")).where(F.trim("text") != "")
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    body = rows.where(~F.col("first"))
    if schema is None:
        names = _header(rows, sep)
        plain = T.StructType([T.StructField(n, T.StringType()) for n in names])
        as_text = body.select(F.from_csv("text", _ddl(plain), options).alias("r")).select("r.*")
        return tokens_to_null(_typed(as_text))
    ddl = schema if isinstance(schema, str) else _ddl(schema)
    return tokens_to_null(body.select(F.from_csv("text", ddl, options).alias("r")).select("r.*"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema.fields)


def _header(rows: DataFrame, sep: str) -> list[str]:
    """Column names from the header of the first file; blank ones get a number, repeated ones too."""
    row = rows.where("first").limit(1).collect()
    if not row:
        return []
    head = next(csv.reader([row[0]["text"]], delimiter=sep))
    names = [n.lstrip("\ufeff") or f"_c{k}" for k, n in enumerate(head)]
    lower = [n.lower() for n in names]
    return [f"{n}{k}" if lower.count(n.lower()) > 1 else n for k, n in enumerate(names)]


INFERRED = ("int", "bigint", "double", "date", "timestamp", "boolean")  # the first type that fits all values is taken


def _typed(df: DataFrame) -> DataFrame:
    """Text columns cast to the first of ``INFERRED`` that holds every value, in one pass; columns without values stay text."""
    if not df.columns:
        return df
    tests = []
    for k, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        known = F.when(~v.isin(*MISSING_TOKENS), v)
        tests.append(F.count(known).alias(f"n{k}"))
        tests += [F.sum((known.isNotNull() & known.try_cast(t).isNull()).cast("long")).alias(f"{t}{k}") for t in INFERRED]
    seen = df.agg(*tests).first()
    kinds = [next((t for t in INFERRED if seen[f"n{k}"] and not seen[f"{t}{k}"]), "string") for k in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`") if t == "string" else F.col(f"`{c}`").try_cast(t).alias(c) for c, t in zip(df.columns, kinds)])


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """One object per line, or with ``lines=False`` documents that are an array of objects (or objects over many lines).

    Such documents are read range by range, whatever their size; without a schema
    their structure is inferred by a pass over the objects.
    """
    if lines:
        return flatten((spark.read.schema(schema) if schema is not None else spark.read).json(path))
    found = records(spark, path, Brackets(), closing=True)
    # Raw line breaks are mere space in JSON, so every object fits on a line.
    text = F.regexp_replace(F.regexp_replace(F.col("record").cast("string"), r"[\r\n]+", " "), r"^[\s,\[\x{FEFF}]+", "")
    objects = new_path(spark, "objects")
    found.select(text.alias("value")).where(F.col("value").startswith("{")).write.text(objects)
    return flatten((spark.read.schema(schema) if schema is not None else spark.read).json(objects))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to columns named ``a.b``."""

    def walk(fields: Sequence[T.StructField], prefix: str, access: Column | None) -> list[Column]:
        out: list[Column] = []
        for f in fields:
            c = F.col(f"`{f.name}`") if access is None else access[f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, f"{prefix}{f.name}.", c)
            else:
                out.append(c.alias(prefix + f.name))
        return out

    return df.select(*walk(df.schema.fields, "", None))


def probe_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """First of ``ENCODINGS`` that decodes every line of the input; one pass over all bytes.

    The second one, Latin-1, decodes any bytes, so only UTF-8 has to be tested.
    """
    valid = spark.read.text(path).agg(F.bool_and(F.expr("is_valid_utf8(value)")).alias("ok")).first()["ok"]
    return ENCODINGS[0] if valid is None or valid else ENCODINGS[1]


def probe_separator(header: str) -> str:
    """Comma, unless the header line has none and has tabs."""
    return "\t" if "," not in header and "\t" in header else ","


def read_csv_probed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV whose encoding is chosen from all lines, and whose separator from the header."""
    encoding = probe_encoding(spark, path)
    head = spark.read.text(path).select(F.encode(F.make_valid_utf8("value"), "UTF-8").alias("v")).first()
    header = bytes(head["v"]).decode(errors="replace") if head is not None and head["v"] is not None else ""
    spark_name = {"utf-8": "UTF-8", "latin1": "ISO-8859-1"}[encoding]
    return read_csv(spark, path, schema, sep=probe_separator(header), encoding=spark_name)


def clean_names(names: Sequence[str]) -> list[str]:
    return [re.sub(r"[\n\r\t]+", " ", n).strip() for n in names]


def side_table(df: DataFrame) -> DataFrame:
    """Endpoint table: tidy column names, text columns that hold numbers become numeric."""
    return coerce_numeric_text(df.toDF(*clean_names(df.columns)))


def read_side_table(spark: SparkSession, path: str) -> DataFrame:
    return side_table(read_csv(spark, path))


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per report file: (file, content)."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content")
    )


def read_groups(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_groups(read_reports(spark, path)).drop("file")


def parse_groups(files: DataFrame) -> DataFrame:
    """Group-definition text (file, content) to (group_id, group_name, item_no, descriptor) rows.

    A group starts at a line like ``3. Topological indices``; its items follow a
    line ``Name``, one per line. Headers are carried down inside each text by
    array functions, so files are parsed side by side and never shuffled.
    """
    lines = F.transform(F.split("content", "\n"), strip_all)
    text = F.array_join(F.filter(lines, lambda l: l != ""), "\n")
    # A marker before every header cuts the text into one piece per group.
    marked = F.regexp_replace(F.concat(F.lit("\n"), text), r"\n(?=\d[^\n]*?\. )", "\u0001")
    # In steps, so that no text is cut twice.
    b = files.select("file", F.split(marked, "\u0001").alias("pieces"))
    n = F.size("pieces")
    b = b.select("file", F.posexplode(F.when(n > 1, F.slice("pieces", F.lit(2), n))).alias("g", "block"))
    b = b.select("file", F.split("block", "\n").alias("lines"))
    b = b.select("file", F.get("lines", F.lit(0)).alias("head"), F.slice("lines", F.lit(2), F.size("lines")).alias("after"))
    start = F.array_position("after", F.lit("Name"))
    items = F.filter(F.slice("after", start + 1, F.size("after")), lambda l: l != "Name")
    rows = b.select(
        "file", F.regexp_extract("head", r"^(.*?)\. ", 1).alias("group_id"), F.regexp_extract("head", r"^.*?\. (.*)$", 1).alias("group_name"),
        F.posexplode_outer(F.when(start > 0, items)).alias("item_no", "descriptor"),
    )
    return rows


def group_summary(groups: DataFrame) -> DataFrame:
    """Groups, descriptors and the group names in order."""
    per = groups.groupBy("group_id", "group_name").agg(F.count("descriptor").alias("n_descriptors"))
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_descriptors").alias("total_descriptors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("group_id").try_cast("int").alias("i"), "group_name"))), lambda s: s["group_name"]), "; ").alias("names"),
    )
