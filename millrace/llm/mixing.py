"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of source s is repeated Poisson(rate_s) times, rate_s = target share x all / size of s.
The count inverts the Poisson distribution at a number hashed from (seed, id), so it is the same
on every machine and every retry; the copies are dealt out and ordered by another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import SALTS, salt

#: A source table of at most this many rows (one per source) is broadcast; a larger one is joined salted.
BROADCAST_SOURCES = 10_000
#: Rates above it are drawn as a sum of this many times smaller ones, as exp(-rate) would vanish.
MAX_RATE = 50.0


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... to well beyond where it reaches 1 in double precision."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return F.aggregate(steps, start, step, lambda acc: acc["cdf"])


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", size_col: str | None = None, seed: int = 17, prefix: str = "mix_") -> DataFrame:
    """All columns of ``df`` once per copy, with ``<prefix>rate``, ``<prefix>copies``, ``<prefix>copy``
    (from 0) and ``<prefix>order``, dealt out and sorted by ``<prefix>order`` (a hash of seed, id and copy).

    ``weights``: target share of each source, scaled to sum to 1; None asks for equal shares of all
    sources.  A source without a weight, or of weight 0, gives no copies.  A null source
    is a source of its own, named None in ``weights``.  ``size_col`` weighs by a size (tokens, say; null
    or negative counts 0) instead of by rows.  The expected output has as many rows (or as much size) as the input.
    Rows with equal ids get equal counts; a null id is hashed as the empty string.  No rows: no rows.
    Columns of ``df`` that have the new columns' names (of a table that was mixed before) are replaced.

    Only per-source totals (one row per source) are joined: broadcast when there are at most
    ``BROADCAST_SOURCES``, else salted, so that one source may hold any share of the rows.
    """
    c = {k: f"{prefix}{k}" for k in ("rate", "copies", "copy", "order")}
    df = df.drop(*(n for n in c.values() if n in df.columns))
    size = F.lit(1.0) if size_col is None else F.greatest(F.coalesce(F.col(size_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    name = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    totals = df.select(name.alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").alias("__size"))
    if weights is None:
        want = F.lit(1.0)
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in ("-" if k is None else f"+{k}", float(v))]
        want = F.coalesce(F.element_at(F.create_map(*pairs), F.col("__source")), F.lit(0.0)) if pairs else F.lit(0.0)
    totals = totals.withColumn("__want", want)
    overall = totals.agg(F.sum("__size").alias("__all"), F.sum("__want").alias("__wants"), F.count(F.lit(1)).alias("__n")).first()
    if not overall["__n"]:
        totals = totals.withColumn(c["rate"], F.lit(0.0))
    else:
        totals = totals.withColumn(c["rate"], F.when((F.col("__want") > 0) & (F.col("__size") > 0), F.col("__want") / F.lit(overall["__wants"] or 1.0) * F.lit(overall["__all"]) / F.col("__size")).otherwise(F.lit(0.0)))
    parts = F.greatest(F.ceil(F.col(c["rate"]) / MAX_RATE), F.lit(1)).cast("int")
    rates = totals.where(F.col(c["rate"]) > 0).select("__source", c["rate"], parts.alias("__parts")).withColumn("__cdf", poisson_cdf(F.col(c["rate"]) / F.col("__parts")))
    rows = df.withColumn("__source", name)
    if overall["__n"] <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), "__source")
    else:
        repeated = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", salt(id_col)).join(repeated, ["__source", "__salt"])
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))

    def draw(i: Column) -> Column:
        drawn = F.array(unit(F.lit(str(seed)), ident, i.cast("string")))  # hashed once, not for every step of the distribution
        return F.transform(drawn, lambda u: F.size(F.filter("__cdf", lambda x: x <= u)))[0]

    counted = joined.withColumn(c["copies"], F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, i: acc + draw(i)))
    out = counted.where(F.col(c["copies"]) > 0).withColumn(c["copy"], F.explode(F.sequence(F.lit(0), F.col(c["copies"]) - 1)))
    out = out.withColumn(c["order"], F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col(c["copy"]).cast("string")).cast("binary")))
    return out.select(*df.columns, *c.values()).repartition(c["order"]).sortWithinPartitions(c["order"])


#: DuckDB: the query's rows for equal shares and seed 17, while no rate exceeds MAX_RATE.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source
), r AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM t) * (SELECT sum(n) FROM t) / n AS rate FROM t
), c AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), u AS (
  SELECT d.*, ('0x' || substr(md5('17:' || d.doc_id || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d
), n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, c.rate AS mix_rate, count(*) FILTER (c.cdf <= u.u)::INTEGER AS mix_copies
  FROM u JOIN c ON u.source = c.source GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, mix_rate, mix_copies, k::INTEGER AS mix_copy, md5('order17:' || doc_id || ':' || k) AS mix_order
FROM n, unnest(range(mix_copies)) AS x(k)
"""
