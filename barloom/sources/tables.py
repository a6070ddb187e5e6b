"""Scans and sinks for bars: Parquet, CSV, a catalog of what is cached, upserts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barloom.operators.bars import WIDTHS, keep_last, resample

SCHEMA = "stream_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
CSV_SCHEMA = "ts timestamp_ntz, open double, high double, low double, close double, volume double"
# Interval names that cached files carry, longest first so that 15min is not read as 5min.
INTERVALS = sorted("1s 5s 10s 15s 30s 1min 2min 3min 5min 10min 15min 20min 30min 1hour 2hour 3hour 4hour 1day 1week 1month".split(), key=lambda x: (-len(x), x))
TF_OF = {"1min": "1m", "5min": "5m", "15min": "15m", "30min": "30m", "1hour": "1h", "4hour": "4h", "1day": "1d", "1week": "1w"}


def read_bars(spark: SparkSession, path: str) -> DataFrame | None:
    """Bars at a Parquet path, or None if there is nothing; any path that Spark can open."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def bars_from_rows(spark: SparkSession, rows: list[tuple], stream: str) -> DataFrame:
    """Bars from (ts, open, high, low, close[, volume]) rows of one stream; a missing volume is null."""
    return spark.createDataFrame([(stream, *r, *[None] * (6 - len(r))) for r in rows], SCHEMA)


def write_bars(bars: DataFrame, path: str, by_stream: bool = True) -> None:
    """Overwrite a Parquet table, one folder a stream, so that a read of one stream opens its files only."""
    writer = bars.write.mode("overwrite")
    (writer.partitionBy("stream_id") if by_stream else writer).parquet(path)


def append_bars(bars: DataFrame, path: str, batch: int) -> None:
    """Add a batch of rows to an upsert table; the same batch again replaces itself. See ``read_upserted``."""
    bars.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of an upsert table: of repeats of a (stream_id, ts) that of the latest batch."""
    found = read_bars(spark, path)
    return None if found is None else keep_last(found, "batch")


def read_csv(spark: SparkSession, path: str, stream: str | None = None) -> DataFrame:
    """Bars from CSV files with a header; the stream is named or taken from the file's name up to its first underscore or its ending.

    Columns go by their names, in any order and case: ts or timestamp, open, high, low, close
    and volume (null if there is none); others are left out. Files of one read share a header:
    one that differs raises, and so does a header without a price.
    """
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, header=True, enforceSchema=False)
    by_name = {n.strip().lower(): n for n in reversed(names)}
    by_name.setdefault("ts", by_name.get("timestamp"))
    wanted = [c.split() for c in CSV_SCHEMA.split(", ")]
    if missing := [n for n, _ in wanted if n != "volume" and not by_name.get(n)]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    columns = [(F.trim(F.col(f"`{by_name[n]}`")) if by_name.get(n) else F.lit(None)).cast(kind).alias(n) for n, kind in wanted]
    name = F.lit(stream) if stream else F.regexp_extract(F.input_file_name(), r"([^/_]+?)(?:_[^/]*)?(?:\.csv(?:\.[a-z0-9]+)?)?$", 1)
    return rows.select(name.alias("stream_id"), *columns)


def write_csv(bars: DataFrame, path: str) -> None:
    bars.write.mode("overwrite").csv(path, header=True)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, interval, name) of files called symbol_interval_raw.parquet in a folder.

    Names come from the file system that the folder is on; contents are not read.
    """
    pattern = re.compile(rf"^(.+)_({'|'.join(INTERVALS)})_raw\.parquet$")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    rows = [(m[1], m[2], m[0].removesuffix(".parquet")) for m in map(pattern.match, names) if m]
    return spark.createDataFrame(rows, "symbol string, interval string, name string")


def load_bars(spark: SparkSession, folder: str, symbol: str, interval: str, tf: str) -> DataFrame | None:
    """Cached bars of a symbol in a timeframe: as they are if it is theirs or is not known, else resampled. None if nothing is cached."""
    found = read_bars(spark, f"{folder.rstrip('/')}/{symbol}_{interval}_raw.parquet")
    if found is None:
        return None
    if "stream_id" not in found.columns:
        found = found.withColumn("stream_id", F.lit(symbol))
    return found if tf == TF_OF.get(interval) or tf not in (*WIDTHS, "1w") else resample(found, tf)
