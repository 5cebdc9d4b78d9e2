"""Registered checks: a Spark query over the test tables plus, where the
semantics are expressible in SQL, the equivalent DuckDB query.

``queries()`` and ``oracle_sql()`` of ``__spark_entry__`` are read from
here. Each Spark query reads whole tables (``sf_dir``) and each oracle
reads the same tables as pre-registered views.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir
from quarry.sources.tables import read_table


@dataclass
class Check:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op_ids: tuple[str, ...]


CHECKS: dict[str, Check] = {}


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn):
        if name in CHECKS:
            raise ValueError(f"duplicate check {name}")
        CHECKS[name] = Check(name, fn, sql, ops)
        return fn
    return deco


class Tables:
    """Lazy table access for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load_all() -> dict[str, Check]:
    # importing the catalog modules fills CHECKS
    from quarry.plans import (catalog_chat, catalog_core, catalog_eval, catalog_index, catalog_io,  # noqa: F401
                              catalog_retrieval, catalog_stream, catalog_text)
    return CHECKS
