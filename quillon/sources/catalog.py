"""The catalogue as tables: names, columns and types of frames or of the session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "default") -> DataFrame:
    """One row for each column. Metadata only: no table is read."""
    rows = [(schema, name, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for name, df in sorted(tables.items()) for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position long, data_type string, is_nullable string")


def tables_of(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "default") -> DataFrame:
    rows = [(schema, name, "BASE TABLE", len(df.columns)) for name, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string, n_columns long")


def schemata_of(spark: SparkSession) -> DataFrame:
    rows = [(d.catalog or "", d.name) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "catalog_name string, schema_name string")


def views_of(spark: SparkSession, views: Mapping[str, str], schema: str = "default") -> DataFrame:
    rows = [(schema, name, text) for name, text in sorted(views.items())]
    return spark.createDataFrame(rows, "table_schema string, table_name string, view_definition string")


def statistics_of(spark: SparkSession, tables: Mapping[str, Mapping], schema: str = "default") -> DataFrame:
    """One row for each column of each key and index, from what the tables keep of themselves."""
    rows = []
    for name, meta in sorted(tables.items()):
        named = [i["columns"] for i in meta.get("indexes", []) if i["unique"]]
        listed = [("PRIMARY", meta["key"], True), *(("_".join(k), k, True) for k in meta["unique"] if k not in named), *((i["name"], i["columns"], i["unique"]) for i in meta.get("indexes", []))]
        rows += [(schema, name, index, place, column, 0 if unique else 1) for index, columns, unique in listed for place, column in enumerate(columns, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, index_name string, seq_in_index long, column_name string, non_unique long")


def session_tables(spark: SparkSession) -> DataFrame:
    """Tables and views that the session knows."""
    rows = [(".".join(t.namespace or []), t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")
