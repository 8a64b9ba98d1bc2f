"""Uploaded item lists in CSV, and CSV results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import blank_to_null, control_trim
from riskloom.operators.present import EXPORT

REQUIRED, OPTIONAL = ["product_name", "version", "usage_text"], ["vendor", "install_url"]
BOM = "﻿"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; columns and cells trimmed, a byte order mark removed; all strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8")
    return rows.toDF(*(c.lstrip(BOM).strip() for c in rows.columns))


def has_known_header(rows: DataFrame) -> bool:
    return set(REQUIRED) <= set(rows.columns)


def guessed_mapping(rows: DataFrame) -> dict[str, str | None]:
    """field -> the first column of that name, whatever its case."""
    return {f: next((c for c in rows.columns if c.lower() == f), None) for f in [*REQUIRED, *OPTIONAL]}


def items(rows: DataFrame, mapping: dict[str, str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of a list: blank optional cells become null; a row with a blank required cell is a problem with
    its number (the header is number 1) and no item. A required field without a column raises ValueError."""
    mapping = mapping or guessed_mapping(rows)
    missing = [f for f in REQUIRED if mapping.get(f) not in rows.columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    cell = lambda f: blank_to_null(control_trim(F.col(f"`{mapping[f]}`"))) if mapping.get(f) in rows.columns else F.lit(None).cast("string")
    # A list with line breaks in cells is read as a whole file by one task, so the numbers run through it.
    numbered = rows.select((F.monotonically_increasing_id() % (1 << 33) + 2).alias("line"), *(cell(f).alias(f) for f in [*REQUIRED, *OPTIONAL]))
    blank = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED)))
    numbered = numbered.withColumn("blank", blank)
    return numbered.where(F.size("blank") == 0).drop("blank"), numbered.where(F.size("blank") > 0).select("line", "blank")


def write_csv(rows: DataFrame, path: str) -> None:
    """One UTF-8 file with a byte order mark and a header; nulls are empty cells. For results of one upload."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_results(rows: DataFrame, path: str) -> None:
    write_csv(rows.orderBy("item").select(*EXPORT), path)


def template() -> str:
    """An empty list with its header and one example."""
    return BOM + "product_name,version,vendor,usage_text,install_url\nlog4j-core,2.14.1,Apache,logging,\n"
