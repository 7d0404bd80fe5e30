"""The four persisted tables as append-only parquet folders.

Every append is one batch folder, ``<table>/batch_id=<id>``, replaced as a whole. A
batch that is written again after a lost executor or a replayed micro-batch leaves the
same rows, not twice as many.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.schemas import COLUMN_DEFAULTS, NESTED_EVENT, TABLES


class NullValueError(ValueError):
    pass


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns, types and defaults of ``table``.

    Columns that may be left out take their default, also where they are NULL.
    """
    defaults = COLUMN_DEFAULTS[table]
    columns = []
    for field in TABLES[table]:
        default = F.expr(defaults[field.name]) if field.name in defaults else None
        if field.name in df.columns:
            value = F.col(field.name)
            value = value if default is None else F.coalesce(value, default)
        elif default is not None:
            value = default
        elif field.nullable:
            value = F.lit(None)
        else:
            raise NullValueError(f"{table}.{field.name} has no default and is missing")
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(columns)


def checked(df: DataFrame, table: str) -> DataFrame:
    """Fails the writing task on the first NULL in a column that allows none."""
    columns = []
    for field in TABLES[table]:
        value = F.col(field.name)
        if not field.nullable:
            message = F.lit(f"NULL in {table}.{field.name}")
            value = F.when(value.isNull(), F.raise_error(message).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return df.select(columns)


def append(df: DataFrame, root: str, table: str, batch_id: str) -> None:
    ready = checked(conform(df, table), table)
    ready.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def _stored(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _events_of_studies(spark: SparkSession, root: str) -> DataFrame | None:
    """Events that were registered inside their study's row."""
    nested = T.StructType([T.StructField("events", T.ArrayType(NESTED_EVENT))])
    studies = _stored(spark, nested, f"{root}/radiology_studies")
    return None if studies is None else studies.select(F.inline("events")).withColumnRenamed("event_id", "id")


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of all batches; columns that older files lack come back with their default.

    Events registered with their study are among the rows of ``quality_events``.
    """
    schema = TABLES[table]
    rows = _stored(spark, schema, f"{root}/{table}")
    if table == "quality_events" and (nested := _events_of_studies(spark, root)) is not None:
        rows = nested if rows is None else rows.unionByName(nested)
    if rows is None:
        rows = spark.read.schema(schema).parquet(f"{root}/{table}")  # says what is missing
    defaults = COLUMN_DEFAULTS[table]
    return rows.select(
        [
            F.coalesce(F.col(f.name), F.expr(defaults[f.name])).alias(f.name)
            if f.name in defaults
            else F.col(f.name)
            for f in schema
        ]
    )


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Catalog tables with defaults. Running it again changes nothing."""
    for table, schema in TABLES.items():
        columns = []
        for field in schema:
            default = COLUMN_DEFAULTS[table].get(field.name)
            columns.append(
                f"{field.name} {field.dataType.simpleString()}"
                + ("" if field.nullable else " NOT NULL")
                + (f" DEFAULT {default}" if default else "")
            )
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({', '.join(columns)}) USING parquet")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(documents: DataFrame, root: str, batch_id: str) -> None:
    """Report documents (report_object_key, kind, document), one folder per kind."""
    (
        documents.select("report_object_key", "document", "kind")
        .write.mode("overwrite")
        .partitionBy("kind")
        .parquet(f"{root}/documents/batch_id={batch_id}")
    )


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(
        "report_object_key string, document string, batch_id string, kind string"
    ).parquet(f"{root}/documents")
