"""Registry of runnable queries and the equivalent SQL used to check them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Fixed reference times: just after the last event and the last order.
AS_OF = "2024-01-30 23:59:59"
ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENT_NOW = f"TIMESTAMP '{AS_OF}'"
ORDER_NOW = f"TIMESTAMP '{ORDERS_AS_OF}'"


SCHEMAS: dict[str, StructType] = {}


class Tables:
    """Lazy access to the driver tables of one scale factor; a file's schema is inferred once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        table = self.spark.read.schema(SCHEMAS[path]).parquet(path)
        setattr(self, name, table)
        return table

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        """A small rule table kept next to the query that uses it."""
        return self.spark.createDataFrame(data, schema)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def sql_values(data: list[tuple]) -> str:
    """The same small rule table as a SQL VALUES list."""

    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in data)


def load_all() -> dict[str, Query]:
    from fleetlens.plans import bindings

    bindings.load()
    return REGISTRY
