"""Tables in formats other than Parquet, through Spark's own readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..declare import query
from ..model import exact_sum, exact_sum_sql
from ..storage import new_path
from ..tables import table

#: Options that let a format give back what it was given.
FORMATS = {"csv": {"header": "true"}, "json": {}, "orc": {}, "parquet": {}, "text": {}}
SCHEMA = "o_orderkey long, o_orderstatus string, o_totalprice double"


def stored(df: DataFrame, form: str, schema: str) -> DataFrame:
    """S19 a table written in a format to the shared folder and read back with a stated schema; ``text`` holds a
    JSON object a line."""
    spark = df.sparkSession
    path = new_path(spark, form)
    if form == "text":
        df.select(F.to_json(F.struct(*df.columns))).write.text(path)
        return spark.read.text(path).select(F.from_json("value", schema).alias("v")).select("v.*")
    df.write.format(form).options(**FORMATS[form]).save(path)
    return spark.read.format(form).schema(schema).options(**FORMATS[form]).load(path)


@query(f"""SELECT f AS form, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, {exact_sum_sql("o_totalprice")} AS total
FROM orders, (SELECT unnest(['csv', 'json', 'orc', 'parquet', 'text']) AS f) GROUP BY ALL""")
def formats_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19 the same table from each format."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    every = reduce(DataFrame.unionByName, [stored(rows, f, SCHEMA).withColumn("form", F.lit(f)) for f in FORMATS])
    return every.groupBy("form", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), exact_sum("o_totalprice").alias("total"))
