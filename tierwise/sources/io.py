"""Reading inputs and saving run outputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def read_input(spark: SparkSession, source: str, fmt: str | None = None) -> DataFrame:
    """A catalog table name, or a path (parquet unless ``fmt`` says otherwise).

    Reading stays lazy; columns the operators do not use are pruned by the
    optimizer, and filters on the entity reach the scan.
    """
    if fmt is None and ("/" in source or source.endswith(".parquet")):
        fmt = "parquet"
    if fmt is None:
        return spark.read.table(source)
    return spark.read.format(fmt).load(source)


def output_name(base: str, run_name: str, output: str) -> str:
    """Where an output of a run goes: a path below ``base``, or, where ``base`` is
    a catalog prefix (no slash or scheme), a table named after all three."""
    if "/" in base or ":" in base:
        return f"{base.rstrip('/')}/{run_name}/{output}"
    return f"{base}_{re.sub('[^0-9A-Za-z_]', '_', run_name)}_{output}"


def save(df: DataFrame, path: str, *, mode: str = "overwrite", fmt: str = "parquet", partition_by=None) -> None:
    """Write one result. ``path`` without a scheme or slash is a catalog table."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in path or ":" in path:
        writer.format(fmt).save(path)
    else:
        writer.format(fmt).saveAsTable(path)


def read_saved(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back what :func:`save` wrote (a path, or a catalog table name)."""
    if "/" in path or ":" in path:
        return spark.read.format(fmt).load(path)
    return spark.read.table(path)


def save_run(outputs: dict[str, DataFrame], base: str, run_name: str, *, mode: str = "overwrite") -> dict[str, str]:
    """Save every output of a run where :func:`output_name` says.

    The manifest is written as one file (it has three rows); results are
    written in parallel by their own partitions.
    """
    written = {}
    for name, df in outputs.items():
        target = output_name(base, run_name, name)
        if name == "manifest":
            df = df.coalesce(1)
        save(df, target, mode=mode)
        written[name] = target
    return written
