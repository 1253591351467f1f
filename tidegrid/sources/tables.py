"""Table scans with declared schemas, header normalisation, partitioned sinks."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

# Symbols that normalised headers spell out.
HEADER_WORDS = {"%": "_percent_", "#": "_number_"}


def clean_name(header: str) -> str:
    """snake_case form of one header: words split at case changes and punctuation."""
    for symbol, word in HEADER_WORDS.items():
        header = header.replace(symbol, word)
    header = re.sub(r"([a-z])([A-Z])", r"\1_\2", header)
    header = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", header)
    header = re.sub(r"[^0-9A-Za-z]+", "_", header).strip("_").lower()
    return f"x{header}" if not header or header[0].isdigit() else header


def clean_names(headers: list[str]) -> list[str]:
    """Unique snake_case names; repeats get _2, _3, ... in order of appearance."""
    seen: dict[str, int] = {}
    out = []
    for header in headers:
        name = clean_name(header)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema.

    No inference pass runs.  Columns go by position, so headers that differ only in case are
    no problem, and text that does not fit its type becomes NULL.
    """
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=True)


def _shared_base(spark: SparkSession) -> str:
    """Shared folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine without that setting gets a temporary folder, which goes with the process; on a
    cluster the setting is needed, since a folder of one machine is not seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return base.rstrip("/")


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tidegrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{_shared_base(spark)}/tidegrid-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    Later uses do not repeat the work behind it, it survives the loss of executors, and the
    planner knows its size.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, mode="errorifexists")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: list[str]) -> None:
    df.write.partitionBy(*partition_by).csv(path, header=True, mode="errorifexists")
