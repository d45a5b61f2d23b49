"""Raw logger files: TAB-separated records without header, of 14 (legacy) or 20 (current) fields, decided record by record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.time import epoch

#: Channels of a block of the legacy layout (three blocks of four) and of the current one, by position after date and time. Fixed values.
LEGACY = [f"{c}_{b}" for b in (1, 2, 3) for c in ("batt", "tair", "rh", "i")]
CURRENT = [f"zero_{i}" for i in range(1, 13)] + ["batt", "tair", "rh", "i_mv", "sr", "twall"]
EXTRA = 14, 20


def number(token: Column) -> Column:
    """Comma or point decimals; null for anything that isn't a number."""
    return F.replace(F.trim(token), F.lit(","), F.lit(".")).try_cast("double")


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """(era, ts, t, channels...) of lines that have 14 or 20 fields and a date that parses; other lines are skipped."""
    parts = F.split(F.col(value), "\t")
    rows = lines.withColumn("__p", parts).withColumn("__n", F.size("__p")).where(F.col("__n").isin(*EXTRA))
    stamp = F.concat_ws(" ", F.trim(F.get("__p", F.lit(0))), F.trim(F.get("__p", F.lit(1))))
    rows = rows.withColumn("ts", F.try_to_timestamp(stamp, F.lit("dd/MM/yy HH:mm:ss")).cast("timestamp_ntz")).where(F.col("ts").isNotNull())
    current = F.col("__n") == 20
    field = lambda i: number(F.get("__p", F.lit(i + 2)))
    cells = [F.when(~current, field(i)).alias(c) for i, c in enumerate(LEGACY)] + [F.when(current, field(i)).alias(c) for i, c in enumerate(CURRENT) if not c.startswith("zero_")]
    keep = [c for c in lines.columns if c != value]
    return rows.select(*keep, F.when(current, "current").otherwise("legacy").alias("era"), "ts", epoch(F.col("ts")).alias("t"), *cells)


def read_logger(spark: SparkSession, path: str, glob: str = "*.adc") -> DataFrame:
    """All files of a folder in one scan, with the file's name for a defined order of duplicates."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).withColumn("file", F.col("_metadata.file_name"))
    return parse_records(lines)


def files_between(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Records of files whose eight-digit date lies between two dates (yyyyMMdd), both included."""
    return rows.where(F.regexp_extract("file", r"(\d{8})", 1).between(first, last))
