"""Reading inputs: transactions, products, stores, submissions, stage tables, and the demand view of star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_date", T.TimestampType()),
        T.StructField("internal_store_id", T.StringType()),
        T.StructField("internal_product_id", T.LongType()),
        T.StructField("pdv", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("gross_value", T.DoubleType()),
        *(T.StructField(c, T.StringType()) for c in ("categoria", "premise", "subcategoria", "tipos", "label", "fabricante", "marca", "descricao")),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def role(columns) -> str:
    """What a raw table is, by its columns."""
    columns = set(columns)
    if {"quantity", "internal_product_id"} <= columns:
        return "transactions"
    return "stores" if "zipcode" in columns else "products"


def read_raw_folder(spark: SparkSession, pattern: str, expected: int = 3) -> dict[str, DataFrame]:
    """The tables that match the pattern, by role; there must be just as many as expected."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    paths = [str(f.getPath()) for f in found]
    if len(paths) != expected:
        raise FileNotFoundError(f"{len(paths)} tables match {pattern}, not {expected}")
    tables = [spark.read.parquet(p) for p in paths]
    return {role(t.columns): t for t in tables}


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("semana int, pdv bigint, produto bigint, quantidade int").option("sep", ";").option("header", True).csv(path)


def forecast_weeks(spark: SparkSession, n: int = 5, name: str = "semana_do_ano") -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias(name))


def demand_transactions(spark: SparkSession, sf_dir: str, store: str = "nation") -> DataFrame:
    """Transactions made of lineitem with part, supplier and nation.

    A store is a supplier's nation (dense histories) or the supplier (sparse ones); a product is a brand.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    df = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    df = df.join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select(
        F.col("l_shipdate").alias("transaction_date"), (F.col("s_nationkey") if store == "nation" else F.col("l_suppkey")).cast("bigint").alias("pdv"),
        F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint").alias("internal_product_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("gross_value"),
        F.col("p_type").alias("categoria"), F.col("n_name").alias("premise"), F.col("p_brand").alias("subcategoria"), F.col("p_size").cast("string").alias("fabricante"),
    )
