"""Sources and sinks: every query writes a table to a fresh folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat.catalog import Catalog
from creditfeat.catalog.fixtures import applicants, applicants_sql, table
from creditfeat.sources import tables, workbooks
from creditfeat.staging import fresh_path

CATALOG = Catalog()


@CATALOG.query("SELECT * FROM orders")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "orders"), fresh_path(spark, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


@CATALOG.query("SELECT * FROM customer")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "customer"), fresh_path(spark, "json")
    tables.write_json_lines(df, path)
    return tables.read_json_lines(spark, path, df.schema)


@CATALOG.query("SELECT * FROM part")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child tags come back as text and are cast afterwards."""
    df = table(spark, sf_dir, "part")
    path = fresh_path(spark, "xml")
    tables.write_xml_records(df, path)
    texts = ", ".join(f"{c} string" for c in df.columns)
    back = tables.read_xml_records(spark, path, texts)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in df.schema])


@CATALOG.query("SELECT * FROM lineitem")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "lineitem"), fresh_path(spark, "parquet")
    tables.write_parquet(df, path)
    return tables.read_parquet(spark, path)


@CATALOG.query("SELECT * FROM orders")
def workbook_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns written as .xlsx files and read back."""
    df, path = table(spark, sf_dir, "orders"), fresh_path(spark, "xlsx")
    workbooks.write_workbooks(df, path)
    return workbooks.read_workbooks(spark, path, df.schema)


_X = ["customer_ref", "loan_amount", "age"]


@CATALOG.query(
    f"""WITH {applicants_sql([*_X, "default"])}
    SELECT customer_ref, loan_amount, age, "default" FROM applicants"""
)
def xy_key_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels in two files, paired by key and not by position."""
    df = applicants(spark, sf_dir, [*_X, "default"])
    x_path, y_path = fresh_path(spark, "x"), fresh_path(spark, "y")
    tables.write_parquet(df.select(*_X), x_path)
    tables.write_parquet(df.select("customer_ref", "default"), y_path)
    x, y = tables.read_parquet(spark, x_path), tables.read_parquet(spark, y_path)
    return x.join(y, "customer_ref")
