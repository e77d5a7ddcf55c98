"""JSON records as DataFrames, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..program import Program


def from_file(spark: SparkSession, program: Program, path: str, lines: bool = False) -> DataFrame:
    """Input records of JSON files: one value per file, or one per line."""
    return spark.read.schema(program.input_schema).option("multiLine", not lines).json(path)


def from_text(spark: SparkSession, program: Program, *texts: str) -> DataFrame:
    """Input records given as JSON texts."""
    rows = spark.createDataFrame([(t,) for t in texts], "j string")
    return rows.select(F.from_json("j", program.input_schema).alias("r")).select("r.*")


def to_text(df: DataFrame) -> DataFrame:
    """Each row as compact JSON in a column `value`; missing values are kept as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
