"""Where relations come from: Parquet files, CSV folders, tables and views, or DataFrames at hand."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parquet_folder(spark: SparkSession, path: str, derived: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] | None = None) -> Callable[[str], DataFrame]:
    """Name to `<path>/<name>.parquet`; `derived` relations are built from others when asked for, and each is built once."""
    built: dict[str, DataFrame] = {}

    def relation(name: str) -> DataFrame:
        if name not in built:
            built[name] = derived[name](relation) if derived and name in derived else spark.read.parquet(f"{path}/{name}.parquet")
        return built[name]

    return relation


def csv_folder(spark: SparkSession, path: str, schemas: dict[str, str], null_value: str = "") -> Callable[[str], DataFrame]:
    """Name to `<path>/<name>.csv` with a header and a declared schema."""
    return lambda name: spark.read.csv(f"{path}/{name}.csv", header=True, schema=schemas[name], nullValue=null_value)


def tables(spark: SparkSession) -> Callable[[str], DataFrame]:
    return spark.table


#: What a semicolon doesn't end a statement in: quoted text and names, and comments.
_INERT = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)


def statements(script: str) -> list[str]:
    """The statements of a script, without comments; a semicolon within quotes or a comment ends none."""
    out, held, at = [], "", 0
    for m in [*_INERT.finditer(script), None]:
        *ended, rest = script[at : m.start() if m else len(script)].split(";")
        for part in ended:
            out.append(held + part)
            held = ""
        held += rest
        if m:
            held += " " if m.group().startswith(("--", "/*")) else m.group()
            at = m.end()
    return [x.strip() for x in (*out, held) if x.strip()]


def seed_sql(spark: SparkSession, script: str) -> None:
    """Runs the statements of a script in their order."""
    for statement in statements(script):
        spark.sql(statement)
