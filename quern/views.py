"""Domain views over the provided tables; the only place that knows their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: four consecutive ones make a page, the first line is the title."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.floor(F.col("doc_id") / 4).cast("long").alias("page_id"),
        F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("root_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def query_terms(spark: SparkSession, sf_dir: str, item: int = 0, most: int = 3) -> list[str]:
    """The first few distinct tokens of one benchmark item: the search box."""
    row = table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item).select(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).first()
    return list(dict.fromkeys((row[0] if row else None) or []))[:most]


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = vectors(spark, sf_dir).filter(F.col("chunk_id") == vec_id).select("vector").first()
    return list(row[0]) if row and row[0] else []


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as metadata rows of pages, with properties of every type."""
    key, priority, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    fields = {"kind": "string", "text": "string", "number": "double", "flag": "boolean", "start": "string", "items": "array<string>"}

    def prop(kind: str, **value):
        return F.struct(F.lit(kind).alias("kind"), *[value.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items() if n != "kind"])

    dated = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    due = F.when(key % 8 == 7, prop("text", text=dated)).otherwise(prop("date", start=dated))
    owner = F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string"))
    always = [F.lit("status"), prop("text", text=status), F.lit("price"), prop("number", number=F.col("o_totalprice")), F.lit("urgent"), prop("flag", flag=priority == "1-URGENT"), F.lit("due"), due]
    lists = [F.lit("tags"), prop("strings", items=F.array(status, priority)), F.lit("owners"), prop("person_ids", items=F.array(owner))]
    pairs = F.create_map(*always, *lists)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("page_id"),
        priority.alias("root_id"),
        status.alias("workspace_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("d"), (F.col("o_custkey") % 7).cast("string"))).alias("database_id"),
        F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string"))).alias("data_source_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_edited"),
        F.when(key % 4 == 0, F.map_concat(pairs, F.create_map(F.lit("note"), prop("null")))).otherwise(pairs).alias("properties"),
    )
