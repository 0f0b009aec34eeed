"""Raw tables of the model: schemas, Parquet and CSV readers, and writers for results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Column names and types of the raw inputs (fixed values; "lenght" is spelt so in the data).
RAW_SCHEMAS = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
    "customer_city string, customer_state string",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, "
    "seller_state string",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
    "product_description_lenght int, product_photos_qty int, product_weight_g double, "
    "product_length_cm double, product_height_cm double, product_width_cm double",
    "category_translation": "product_category_name string, product_category_name_english string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, "
    "geolocation_lng double, geolocation_city string, geolocation_state string",
    "orders": "order_id string, customer_id string, order_status string, "
    "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
    "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
    "order_estimated_delivery_date timestamp_ntz",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
    "shipping_limit_date timestamp_ntz, price double, freight_value double",
    "payments": "order_id string, payment_sequential int, payment_type string, "
    "payment_installments int, payment_value double",
    "reviews": "review_id string, order_id string, review_score int, "
    "review_comment_title string, review_comment_message string, "
    "review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    "postal_directory": "cep string, localidade string, sigla_uf string, id_municipio string, "
    "lon double, lat double",
}


def raw_schema(name: str) -> StructType:
    return StructType.fromDDL(RAW_SCHEMAS[name])


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """CSV with a header; comment texts may hold quotes and line breaks."""
    return (
        spark.read.schema(raw_schema(name))
        .option("header", True)
        .option("multiLine", name == "reviews")
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def read_csv_checked(spark: SparkSession, path: str, name: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of a raw CSV table; no row is lost.

    Every field is first read as text (quoted fields may hold quotes and line breaks), so a record
    with too few or too many fields is set apart by the reader itself. Each field is then converted
    with ``try_cast`` to the model's type; a record whose field does not convert, or whose ``key``
    (default: the first column) is missing, is a reject. Rejects carry the file, the reason (the
    first failing check, in column order), the key as read and the record's text.
    """
    schema = raw_schema(name)
    key = key or schema.fields[0].name
    text = StructType([StructField(f.name, StringType()) for f in schema] + [StructField("_corrupt", StringType())])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    failures = [
        F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(),
               F.concat(F.lit(f"{f.name}: not {f.dataType.simpleString()}: "), F.col(f.name)))
        for f in schema
    ]
    reason = F.coalesce(
        F.when(F.col("_corrupt").isNotNull(), F.lit(f"fields: not {len(schema.fields)}")),
        F.when(F.col(key).isNull() | (F.trim(F.col(key)) == ""), F.lit(f"{key}: missing")),
        *failures,
    )
    checked = raw.withColumn("_reason", reason)
    rows = checked.where(F.col("_reason").isNull()).select(*[typed[f.name].alias(f.name) for f in schema])
    record = F.coalesce(F.col("_corrupt"), F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in schema]))
    rejects = checked.where(F.col("_reason").isNotNull()).select(
        F.col("_file").alias("file"), F.col(key).alias("key"), F.col("_reason").alias("reason"), record.alias("record"))
    return rows, rejects


def read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet checked against the model: a missing column fails here, not in a mart."""
    df = spark.read.parquet(path)
    missing = [f.name for f in raw_schema(name) if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing} in {path}")
    return df.select(*[f.name for f in raw_schema(name)])


def read_raw(spark: SparkSession, base: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every raw table below one folder, ``<base>/<name>`` with the format's suffix."""
    reader = {"parquet": read_parquet, "csv": read_csv}[fmt]
    return {n: reader(spark, f"{base}/{n}.{fmt}", n) for n in RAW_SCHEMAS}


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Replace a stored table and read it back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_buckets(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df``, dealt by ``key`` into ``buckets`` partitions, stored as one file a bucket and read back:
    joins and groups on ``key`` then need no shuffle. Spark keeps buckets only for tables of its
    catalog, so the files are registered there under a new name."""
    name = f"martloom_{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").format("parquet").option("compression", "zstd")
    writer.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def extract(
    df: DataFrame, where: str | None = None, order_by: list | None = None, limit: int | None = None
) -> DataFrame:
    """Filter, order and cut a mart for a report."""
    out = df.where(where) if where else df
    out = out.orderBy(*order_by) if order_by else out
    return out.limit(limit) if limit is not None else out


def export_csv(df: DataFrame, path: str) -> None:
    """Write a result as CSV with a header; arrays become text joined by '|'."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    flat = [
        F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if c in arrays else F.col(c)
        for c in df.columns
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def metric_rows(one_row: DataFrame) -> DataFrame:
    """Turn a one-row summary into (metric, value) rows."""
    doubles = one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns])
    return doubles.unpivot([], one_row.columns, "metric", "value")
