"""Scans, landing, materialisation and the catalog."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.guarded import GuardedSession
from tidemill.queries.marts import STATS_BY_NATION_SQL, stats_by_nation
from tidemill.queries.registry import catalog_tables, layers, query, read
from tidemill.session import local_frame, new_scratch
from tidemill.sinks.landing import Dataset, TableSpec, land_dataset, land_source, save_table
from tidemill.sinks.models import SANDBOX, drop_sandbox, materialize, sandbox_build
from tidemill.sources.catalog import list_columns
from tidemill.sources.files import read_json, read_source
from tidemill.sources.paths import filesystem

CUSTOMER_AS_TEXT_SQL = """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
"""


def write_zips(df: DataFrame, path: str, prefix: str = "part", json: bool = False) -> int:
    """Write a DataFrame as zipped CSV with header, or as JSON lines, one archive per partition; returns the row count."""
    target_fs, folder = filesystem(path)
    target_fs.create_dir(folder, recursive=True)
    names = df.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out_fs, out = filesystem(path)
        label = f"{prefix}-{TaskContext.get().partitionId():05d}"
        partial = f"{out}/_{label}-{uuid.uuid4().hex}"
        rows = 0
        with out_fs.open_output_stream(partial) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open(f"{label}.json" if json else f"{label}.csv", "w", force_zip64=True) as member:
                if not json:
                    member.write((",".join(names) + "\n").encode())
                for batch in batches:
                    rows += len(batch)
                    text = batch.to_json(orient="records", lines=True) if json else batch.to_csv(index=False, header=False)
                    member.write(text.encode())
        out_fs.move(partial, f"{out}/{label}.zip")
        yield pd.DataFrame({"rows": [rows]})

    return df.mapInPandas(pack, "rows long").agg(F.sum("rows")).first()[0]


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, f"{sf_dir}/orders.parquet")


@query("scan_json", "SELECT * FROM events")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as one object per line and read back with inferred types."""
    events = read(spark, sf_dir, "events")
    path = new_scratch(spark, "events")
    events.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return read_json(spark, path, columns=events.columns)


def _as_text(df: DataFrame, label: str, sep: str) -> str:
    path = new_scratch(df.sparkSession, label)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("scan_csv", CUSTOMER_AS_TEXT_SQL)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, _as_text(read(spark, sf_dir, "customer"), "customer", ","), delimiter=",")


@query(
    "scan_tsv",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared delimiter, spelled as an escape."""
    return read_source(spark, _as_text(read(spark, sf_dir, "part"), "part", "\t"), delimiter=r"\t")


@query("scan_sniffed", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def scan_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No delimiter declared."""
    return read_source(spark, _as_text(read(spark, sf_dir, "supplier"), "supplier", ";"))


@query("scan_csv_multiline", "SELECT * FROM documents")
def scan_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks, written as CSV and read back."""
    path = new_scratch(spark, "documents")
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "emptyValue": ""}
    read(spark, sf_dir, "documents").write.options(header=True, **plain).csv(path)
    return read_source(spark, path)


@query("scan_zip", CUSTOMER_AS_TEXT_SQL)
def scan_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers zipped into several archives, read back as one table."""
    path = new_scratch(spark, "customers") + ".zip"
    write_zips(read(spark, sf_dir, "customer").repartition(4, "c_custkey"), path)
    return read_source(spark, path)


@query("scan_zip_json", CUSTOMER_AS_TEXT_SQL)
def scan_zip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON lines in archives."""
    customers = read(spark, sf_dir, "customer")
    path = new_scratch(spark, "customers") + ".zip"
    write_zips(customers.repartition(3, "c_custkey"), path, json=True)
    return read_source(spark, path).select(*customers.columns)


@query("scan_json_mixed", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def scan_json_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of which some files hold one object per line and others one array."""
    nations = read(spark, sf_dir, "nation")
    path = new_scratch(spark, "nations")
    low = F.col("n_nationkey") % 3 == 0
    nations.where(low).write.json(path)
    array = F.to_json(F.collect_list(F.struct(*nations.columns)))
    nations.where(~low).groupBy(F.col("n_nationkey") % 2).agg(array.alias("value")).select("value").write.mode("append").text(path)
    return read_json(spark, path, columns=nations.columns)


@query("scan_json_array", CUSTOMER_AS_TEXT_SQL)
def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a few files of one JSON array each, every object over several lines."""
    customers = read(spark, sf_dir, "customer")
    path = new_scratch(spark, "customers")
    objects = customers.repartition(3, "c_custkey").select(F.to_json(F.struct(*customers.columns), {"pretty": "true"}).alias("value"))
    objects.mapInPandas(_as_array, "value string").write.text(path)
    return read_json(spark, path, columns=customers.columns)


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of a file that is one array of the given objects."""
    begun = False
    for batch in batches:
        if len(batch):
            lines = "," + batch["value"]
            if not begun:
                lines.iloc[0] = "[" + batch["value"].iloc[0]
            begun = True
            yield lines.to_frame()
    yield pd.DataFrame({"value": ["]" if begun else "[]"]})


@query("scan_csv_headers", CUSTOMER_AS_TEXT_SQL)
def scan_csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files name their columns in different orders."""
    customers = read(spark, sf_dir, "customer")
    path = new_scratch(spark, "customers")
    low = F.col("c_custkey") % 3 == 0
    customers.where(low).write.option("header", True).csv(path)
    customers.where(~low).select(*reversed(customers.columns)).write.mode("append").option("header", True).csv(path)
    return read_source(spark, path, delimiter=",").select(*customers.columns)


@query(
    "catalog_listing",
    """
    SELECT c.table_name, CAST(c.ordinal_position - 1 AS INTEGER) AS column_pos, c.column_name,
           CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type,
           n.n_rows
    FROM (SELECT DISTINCT table_name, ordinal_position, column_name, data_type FROM information_schema.columns) c
    JOIN (SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL
          SELECT 'lineitem', count(*) FROM lineitem UNION ALL
          SELECT 'orders', count(*) FROM orders) n ON c.table_name = n.table_name
    """,
)
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns of a database with the row counts of the tables."""
    from tidemill.operators.monitoring import rowcount_snapshot

    db = catalog_tables(spark, sf_dir, "tm_listing", ["customer", "orders", "lineitem"])
    counts = rowcount_snapshot(spark, [db]).select(
        F.split_part("table_name", F.lit("."), F.lit(2)).alias("table_name"), "n_rows"
    )
    return list_columns(spark, [db]).join(counts, "table_name").drop("database")


@query("land_table", "SELECT 'customer' AS table_name, count(*) AS n_rows, min(c_custkey) AS first_key FROM customer")
def land_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed twice, there once."""
    raw = layers(spark, "tm_land").raw
    spec = TableSpec(f"{sf_dir}/customer.parquet", "customer")
    land_source(spark, spec, raw)
    land_source(spark, spec, raw)
    landed = spark.table(f"{raw}.customer")
    return landed.agg(
        F.lit("customer").alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.min("c_custkey").alias("first_key")
    )


@query(
    "land_dataset",
    """
    SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL
    SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation
    """,
)
def land_dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ["customer", "orders", "nation"]
    specs = [TableSpec(f"{sf_dir}/{t}.parquet", t) for t in tables]
    landed = land_dataset(spark, Dataset("tm_sales", specs, new_scratch(spark, "sales")))
    return local_frame(spark, list(landed.items()), "table_name string, n_rows long")


@query("materialize_mart", STATS_BY_NATION_SQL)
def materialize_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship mart as a table of the mart layer."""
    marts = layers(spark, "tm_model").marts
    materialize(stats_by_nation(spark, sf_dir), marts, "mart_stats_by_nation")
    return spark.table(f"{marts}.mart_stats_by_nation")


@query(
    "sandbox_preview",
    """
    SELECT count(*) AS row_count, 3 AS n_columns,
           CASE count(*) WHEN 0 THEN 'zero_rows' WHEN 1 THEN 'one_row' ELSE '' END AS warnings
    FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)
    """,
)
def sandbox_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model tried in the sandbox; returns what the preview says about it."""
    db = catalog_tables(spark, sf_dir, "tm_preview_staging", ["orders"])
    preview = sandbox_build(
        GuardedSession(spark, [db]),
        "mart_spend_by_customer",
        f"SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM {db}.orders GROUP BY o_custkey",
        root=new_scratch(spark, "sandbox"),
    )
    return preview.table.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(preview.table.columns)).alias("n_columns"),
        F.lit(",".join(preview.oddities)).alias("warnings"),
    )


@query("drop_sandbox", "SELECT true AS built, false AS there_after")
def drop_sandbox_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model built from orders in the sandbox and dropped again."""
    db = catalog_tables(spark, sf_dir, "tm_drop_staging", ["orders"])
    sql = f"SELECT o_orderstatus, count(*) AS n_orders FROM {db}.orders GROUP BY o_orderstatus"
    sandbox_build(GuardedSession(spark, [db]), "mart_dropped", sql, root=new_scratch(spark, "sandbox"))
    built = spark.catalog.tableExists(f"{SANDBOX}.mart_dropped")
    drop_sandbox(spark, "mart_dropped")
    return local_frame(spark, [(built, spark.catalog.tableExists(f"{SANDBOX}.mart_dropped"))], "built boolean, there_after boolean")


@query("save_table", "SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders")
def save_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staging view written as a table, replaced, and read back."""
    raw = layers(spark, "tm_save").raw
    orders = read(spark, sf_dir, "orders")
    save_table(orders.where("o_orderstatus = 'O'"), raw, "orders")
    save_table(orders, raw, "orders")
    return spark.table(f"{raw}.orders").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
