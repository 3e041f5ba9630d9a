"""Key-value views of the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkv.functions import keys as K


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_kv(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(K.encode_int(F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").alias("value"))


def lineitem_kv(spark, d) -> DataFrame:
    key = K.composite(K.encode_int(F.col("l_orderkey")), K.encode_int(F.col("l_linenumber")))
    return read(spark, d, "lineitem").select(key.alias("key"), F.col("l_returnflag").alias("value"))


def customer_kv(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(K.encode_int(F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"))


def segment_index(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(K.field_key(F.col("c_mktsegment"), K.encode_int(F.col("c_custkey"))).alias("key"), K.encode_int(F.col("c_custkey")).alias("value"))


def docs_kv(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(K.encode_int(F.col("doc_id")).alias("key"), F.col("text").alias("value"))


def event_log(spark, d) -> DataFrame:
    return commands(read(spark, d, "events"))


def commands(e: DataFrame) -> DataFrame:
    """Events, a table or a stream, as log commands: signup and view set, click and purchase add, error deletes."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "view"), "S").when(kind.isin("click", "purchase"), "A").otherwise("D")
    number = F.floor("value").cast("long")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), K.encode_int(F.col("user_id")).alias("key"), F.when(kind == "signup", F.lit("new")).when(kind == "view", number.cast("string")).alias("value"),
                    F.when(op == "A", number).alias("number"), F.when(F.col("event_id") % 3 == 0, F.floor(F.col("event_id") / 10).cast("long")).alias("txn_id"))


SQL = {
    "orders_kv": "SELECT printf('%021d', o_orderkey) AS key, o_orderstatus AS value FROM orders",
    "lineitem_kv": "SELECT '/' || printf('%021d', l_orderkey) || '/' || printf('%021d', l_linenumber) AS key, l_returnflag AS value FROM lineitem",
    "customer_kv": "SELECT printf('%021d', c_custkey) AS key, c_name AS value FROM customer",
    "segment_index": "SELECT c_mktsegment || '|' || printf('%021d', c_custkey) AS key, printf('%021d', c_custkey) AS value FROM customer",
    "docs_kv": "SELECT printf('%021d', doc_id) AS key, text AS value FROM documents",
    "event_log": """SELECT event_id AS seq, CASE WHEN event_type IN ('signup', 'view') THEN 'S' WHEN event_type IN ('click', 'purchase') THEN 'A' ELSE 'D' END AS op,
        printf('%021d', user_id) AS key, CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value,
        CASE WHEN event_type IN ('click', 'purchase') THEN CAST(floor(value) AS BIGINT) END AS number,
        CASE WHEN event_id % 3 = 0 THEN CAST(floor(event_id / 10) AS BIGINT) END AS txn_id FROM events""",
}
#: Shard bounds used by the queries over orders_kv: (first_key, shard_id).
BOUNDS = [("", 1), (f"{400:021d}", 2), (f"{1000:021d}", 3), (f"{9000:021d}", 4)]
