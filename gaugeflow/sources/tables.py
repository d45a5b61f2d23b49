"""Weather exports and station tables: column maps, units, duplicates, and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.circular import circular_mean, compass_degrees
from gaugeflow.functions.time import epoch
from gaugeflow.operators.grid import on_grid

#: Column maps of the two weather exports (fixed names of their publishers) and factors to common units.
REANALYSIS = {"temperature (degC)": "temp", "relative_humidity (0-1)": "rh", "dewpoint_temperature (degC)": "dew", "surface_solar_radiation (W/m^2)": "sr", "total_precipitation (mm of water equivalent)": "rain", "wind_speed (m/s)": "wind", "wind_direction (deg)": "wdir"}
STATION = {"Temp": "temp", "Umid": "rh", "Dew pt": "dew", "Rad.Sol.": "sr", "Pioggia": "rain", "Vento": "wind", "Dir": "wdir"}
FACTORS = {"rh": 100.0}
CIRCULAR = {"wdir"}


def read_export(spark: SparkSession, path: str, columns: Mapping[str, str], stamp: str = "datetime", sep: str = ",", stamp_format: str | None = None, factors: Mapping[str, float] = FACTORS) -> DataFrame:
    """(t, quantities...): every column is read as text and cast without errors; absent columns are null; the first row of a repeated time stays."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    ts = F.try_to_timestamp(F.col(f"`{stamp}`"), *([F.lit(stamp_format)] if stamp_format else []))
    cell = lambda src, q: compass_degrees(F.col(f"`{src}`")) if q in CIRCULAR and stamp_format else F.replace(F.col(f"`{src}`"), F.lit(","), F.lit(".")).try_cast("double") * factors.get(q, 1.0)
    cells = [(cell(src, q) if src in raw.columns else F.lit(None).cast("double")).alias(q) for src, q in columns.items()]
    rows = raw.select(epoch(ts.cast("timestamp_ntz")).alias("t"), F.monotonically_increasing_id().alias("__i"), *cells).where(F.col("t").isNotNull())
    firsts = [F.min_by(F.struct(q), F.col("__i"))[q].alias(q) for q in columns.values()]
    return rows.groupBy("t").agg(*firsts)


def harmonised_source(df: DataFrame, source: str, quantities: list[str], step: int, least: int = 1) -> DataFrame:
    """(t, <quantity>_<source>...) on a complete grid; directions by their mean vector."""
    out = None
    for q in quantities:
        one = on_grid(df.select(F.lit(source).alias("__s"), "t", F.col(q).alias("value")), ["__s"], step, least=least, how=circular_mean_of if q in CIRCULAR else F.avg)
        one = one.select("t", F.col("value").alias(f"{q}_{source}"))
        out = one if out is None else out.join(one, "t", "full_outer")
    return out


def circular_mean_of(name: str):
    return circular_mean(F.col(name))


def stations(df: DataFrame, config: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Wide logger columns to one long table (station, t, fields...): ``config[station][field]`` names the column; an absent field is null."""
    fields = list(dict.fromkeys(f for c in config.values() for f in c))
    rows = [F.struct(F.lit(s).alias("station"), *[(F.col(c[f]).cast("double") if f in c else F.lit(None).cast("double")).alias(f) for f in fields]) for s, c in config.items()]
    return df.select("t", F.explode(F.array(*rows)).alias("__r")).select("__r.station", "t", *[f"__r.{f}" for f in fields])


def write_archive(df: DataFrame, path: str, by: tuple[str, ...] = ("station",)) -> None:
    """Parquet partitioned by key, rows of a key together."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Gzipped CSV with doubles at a number of significant digits."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    df.withColumns({c: F.format_string(f"%.{digits}g", c) for c in doubles}).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
