"""Sinks: CSV and JSON reports, sample files, tables for plots."""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_report(df: DataFrame, path: str, order: list[str] | None = None, skip_empty: bool = False) -> None:
    """One CSV file with a header in the folder ``path``. For reports, which have a few rows; NaN is empty."""
    if skip_empty and df.isEmpty():
        return
    out = df.orderBy(*order) if order else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite values as nulls, in all floating columns."""
    fix = {f.name: F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) < F.lit(float("inf"))), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(fix) if fix else df


def clean(x):
    """A report value that JSON can hold: non-finite numbers become null."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def json_report(tables: dict[str, DataFrame], meta: dict, path: str, most: int = 10_000) -> dict:
    """Writes small result tables and ``meta`` as one JSON file, anywhere Spark can write, and returns it. A table of
    more than ``most`` rows is an error: it belongs in ``parquet`` or ``csv_report``."""
    report = {"created_at_utc": datetime.now(timezone.utc).isoformat(), **meta}
    for name, t in tables.items():
        rows = t.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        report[name] = [r.asDict(True) for r in rows]
    report = clean(report)
    spark = SparkSession.getActiveSession()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(report, indent=2, allow_nan=False), "utf-8"))
    out.close()
    return report


def json_samples(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, in as many files as there are partitions; null fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def curve(bins: DataFrame, min_pairs: int = 100) -> DataFrame:
    """The bins of a consistency table with enough pairs to plot."""
    return bins.where(F.col("n_pairs") >= min_pairs)
