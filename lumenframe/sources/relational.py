"""Relational and warehouse sources through Spark's JDBC and vendor formats.

Filters, columns and limits on the returned table are pushed into the database by the
optimizer; nothing is spliced into the SQL text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

# JDBC driver classes.
DRIVERS = {
    "postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver",
    "mariadb": "org.mariadb.jdbc.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sqlite": "org.sqlite.JDBC",
}
# Vendor formats for warehouses and document stores.
VENDOR_FORMATS = {"snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery", "mongodb": "mongodb"}


def jdbc_url(kind: str, host: str = "", port: int | None = None, database: str = "") -> str:
    place = f"{host}:{port}" if port else host
    if kind in ("postgresql", "mysql", "mariadb"):
        return f"jdbc:{kind}://{place}/{database}"
    if kind == "sqlserver":
        return f"jdbc:sqlserver://{place};databaseName={database}"
    if kind == "sqlite":
        return f"jdbc:sqlite:{database}"
    raise ValueError(f"unknown database kind: {kind}")


def jdbc_options(url: str, properties: Mapping[str, str] | None = None) -> dict[str, str]:
    kind = url.split(":")[1] if url.startswith("jdbc:") else ""
    options = {"url": url, "fetchsize": "10000", **(properties or {})}
    if kind in DRIVERS:
        options.setdefault("driver", DRIVERS[kind])
    return options


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, partitions: int | None = None, limit: int | None = None,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table or query. With a numeric or time ``partition_column`` it is read in parallel
    slices between the column's smallest and largest value, asked from the database first."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    options = jdbc_options(url, properties)
    source = table if table is not None else f"({query}) src"
    reader = spark.read.format("jdbc").options(**options).option("dbtable", source)
    if partition_column:
        low, high = reader.load().agg(F.min(partition_column), F.max(partition_column)).first()
        if low is not None:
            count = partitions or spark.sparkContext.defaultParallelism
            reader = reader.options(partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high),
                                    numPartitions=str(count))
    df = reader.load()
    return df.limit(limit) if limit else df


def read_vendor(spark: SparkSession, kind: str, options: Mapping[str, str], limit: int | None = None) -> DataFrame:
    """Warehouses and document stores through their connector, which must be on the class path."""
    df = spark.read.format(VENDOR_FORMATS.get(kind, kind)).options(**options).load()
    return df.limit(limit) if limit else df


# The catalog views are standard SQL; SQLite has its own.
_COLUMNS = """select table_schema, table_name, column_name, data_type, is_nullable, ordinal_position
from information_schema.columns where table_schema not in ('information_schema', 'pg_catalog', 'sys', 'mysql', 'performance_schema')"""
_KEYS = """select k.table_schema, k.table_name, k.column_name
from information_schema.table_constraints c join information_schema.key_column_usage k
on c.constraint_name = k.constraint_name and c.table_schema = k.table_schema and c.table_name = k.table_name
where c.constraint_type = 'PRIMARY KEY'"""
_SQLITE = """select '' as table_schema, m.name as table_name, p.name as column_name, p.type as data_type,
case when p."notnull" = 1 then 'NO' else 'YES' end as is_nullable, p.cid + 1 as ordinal_position, p.pk > 0 as is_key
from sqlite_master m join pragma_table_info(m.name) p where m.type in ('table', 'view')"""


def database_schema(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """table_schema, table_name, column_name, data_type, nullable, primary_key, position."""
    if url.startswith("jdbc:sqlite:"):
        found = read_jdbc(spark, url, query=_SQLITE, properties=properties)
        found = found.withColumn("primary_key", F.col("is_key").cast("int") == 1)
    else:
        columns = read_jdbc(spark, url, query=_COLUMNS, properties=properties)
        keys = read_jdbc(spark, url, query=_KEYS, properties=properties).withColumn("primary_key", F.lit(True))
        found = columns.join(keys, ["table_schema", "table_name", "column_name"], "left").fillna(False, ["primary_key"])
    return found.select("table_schema", "table_name", "column_name", "data_type",
                        (F.upper("is_nullable") == "YES").alias("nullable"), "primary_key",
                        F.col("ordinal_position").cast("int").alias("position"))


def session_schema(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None,
                   count_rows: bool = False) -> DataFrame:
    """The same listing for tables of the session's catalog, or of a given set."""
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    out = []
    for name, df in tables.items():
        rows = df.count() if count_rows else None
        out += [(name, f.name, f.dataType.simpleString(), f.nullable, i + 1, rows) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        out, "table_name string, column_name string, data_type string, nullable boolean, position int, row_count long")


def query_table(df: DataFrame, sql: str, name: str = "df") -> DataFrame:
    """SQL text over a table known as ``df``; the result stays lazy."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)
