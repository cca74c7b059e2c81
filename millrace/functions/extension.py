"""User code: scalar and aggregate functions over Arrow batches, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..declare import query
from ..tables import table


@query("SELECT p_partkey, (p_size * 3 + p_partkey % 5)::BIGINT AS score FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 a scalar function over batches."""

    @F.pandas_udf("long")
    def score(size: pd.Series, key: pd.Series) -> pd.Series:
        return size.astype("int64") * 3 + key % 5

    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", score("p_size", "p_partkey").alias("score"))


@query("SELECT p_brand, sum(p_size)::BIGINT AS total, count(*) AS n FROM part GROUP BY ALL")
def udaf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 create, merge values and merge combiners as user code: partial results per batch, merged by a sum."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.groupby("p_brand", as_index=False).agg(total=("p_size", "sum"), n=("p_size", "size"))

    partial = table(spark, sf_dir, "part", "p_brand", "p_size").mapInPandas(combine, "p_brand string, total long, n long")
    return partial.groupBy("p_brand").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@F.udtf(returnType="word string, place int")
class SplitWords:
    """The words of a text and their places."""

    def eval(self, text: str):
        for i, word in enumerate((text or "").split(" ")):
            yield word, i


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, (generate_subscripts(string_split(p_type, ' '), 1) - 1)::INTEGER AS place FROM part")
def udtf_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 a table function applied to every row."""
    spark.udtf.register("split_words", SplitWords)
    table(spark, sf_dir, "part", "p_partkey", "p_type").createOrReplaceTempView("__part_types")
    return spark.sql("SELECT p_partkey, w.word, w.place FROM __part_types, LATERAL split_words(p_type) w")
