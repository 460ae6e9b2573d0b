"""Table files: declared keys and one measure (long) or named measures (wide); nothing is inferred, findings are reported."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.values import NUMBER, blank, number
from tallygrove.operators.tables import melt
from tallygrove.report import OpResult, Refusal, refuse_when


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text. Headers must be filled and unique; a ragged row ends the job."""
    first = [r[0] for r in spark.read.text(path).limit(1).collect()]
    if not first:
        raise Refusal("the file is empty")
    # the header line decides the columns; quotes are CSV's, a byte order mark goes
    header = [h.strip() for h in spark.read.option("sep", separator).csv(spark.sparkContext.parallelize([first[0].lstrip("﻿")], 1)).first()]
    if any(not h for h in header) or len(set(header)) < len(header):
        raise Refusal("each column needs a name of its own")
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.read.schema(schema).option("sep", separator).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).option("mode", "FAILFAST").csv(path)


def long_table(df: DataFrame, keys: Sequence[str], value: str, primary: Sequence[str] = ()) -> OpResult:
    """Trimmed text keys and ``value`` as a number; text that is none becomes unknown. Reports: ``unread`` values, ``trimmed``
    keys, ``repeated`` primary keys."""
    missing = [c for c in (*keys, value, *primary) if c not in df.columns]
    if missing:
        raise Refusal(f"no such column: {', '.join(missing)}")
    text = {k: F.col(f"`{k}`").cast("string") for k in keys}
    out = df.select(*[F.trim(t).alias(k) for k, t in text.items()], number(F.col(f"`{value}`")).alias(value))
    reports = {
        "unread": df.where(~blank(F.col(f"`{value}`")) & ~F.trim(F.col(f"`{value}`").cast("string")).rlike(NUMBER)).groupBy(F.col(f"`{value}`").cast("string").alias("text")).count(),
        "trimmed": df.agg(*[F.count_if(t != F.trim(t)).alias(k) for k, t in text.items()]),
    }
    if primary:
        reports["repeated"] = out.groupBy(*primary).count().where("count > 1")
    return OpResult(out, reports)


def wide_table(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """A wide file melted by its named value columns: keys, measure, value."""
    if len(set(columns.values())) < len(columns):
        raise Refusal("two columns get one name")
    return melt(df.select(*keys, *[number(F.col(f"`{c}`")).alias(c) for c in columns]), keys, columns)


def _sheet(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number and cell texts of a workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().iterfind("m:si", ns)]
        names = [s.get("name") or "" for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iterfind("m:sheets/m:sheet", ns)]
        for i, name in enumerate(names, 1):
            for row in ElementTree.parse(z.open(f"xl/worksheets/sheet{i}.xml")).getroot().iterfind("m:sheetData/m:row", ns):
                cells: dict[int, str | None] = {}
                for c in row.iterfind("m:c", ns):
                    letters = re.match(r"[A-Z]+", c.get("r") or "A")[0]  # type: ignore[index]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    text = v.text if v is not None else "".join(t.text or "" for t in c.iterfind(".//m:t", ns))
                    cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
                yield name, int(row.get("r") or 0), [cells.get(j) for j in range(max(cells, default=-1) + 1)]


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells (array of text): a workbook a task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                made = list(_sheet(content))
                yield pd.DataFrame({"path": [p] * len(made), "sheet": [m[0] for m in made], "row": [m[1] for m in made], "cells": [m[2] for m in made]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, sheet string, row int, cells array<string>")


def read_stata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stata files (any version that pandas reads), value labels as text, a chunk of rows at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with pd.read_stata(io.BytesIO(content), chunksize=50_000) as chunks:
                    for chunk in chunks:
                        yield chunk.astype({c: object for c in chunk.columns if isinstance(chunk[c].dtype, pd.CategoricalDtype)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def write_table(df: DataFrame, path: str, dictionary: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Parquet, and its dictionary (column, type, n_missing) as CSV beside it if a path is named."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    if dictionary:
        back = df.sparkSession.read.parquet(path)
        kinds = df.sparkSession.createDataFrame(back.dtypes, "column string, type string")
        missing = back.agg(*[F.count_if(blank(F.col(f"`{c}`"))).alias(c) for c in back.columns]).unpivot([], back.columns, "column", "n_missing")
        kinds.join(missing, "column").write.option("header", True).csv(dictionary)


def required(df: DataFrame, column: str) -> DataFrame:
    """The table, with the job ending if a cell of the column is blank."""
    return df.withColumn(column, refuse_when(blank(F.col(column)), f"{column} has a blank cell", F.col(column)))
