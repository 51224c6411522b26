"""Registered queries of checks on equations and units, over cards that vary: orders stand in for cards, their lines for equations and parameters."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwright.operators import evaluate, templates, units
from cardwright.plans.catalogue import _t, query
from cardwright.sources.work import bucketed, buckets

_NUMBERED = "SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_suppkey, l_returnflag FROM lineitem"


def _numbered(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """Lines with their place in the order; dealt by order to so many tasks, if told."""
    lines = _t(spark, d, "lineitem")
    lines = lines.repartition(tasks, "l_orderkey") if tasks else lines
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("l_orderkey").alias("id"), place.alias("n"), "l_suppkey", "l_returnflag")


@query(f"SELECT id, floor(avg(CASE WHEN l_suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS recall FROM ({_NUMBERED}) GROUP BY id")
def equation_recalls(spark: SparkSession, d: str) -> DataFrame:
    """The share of a card's expected symbol sets that its equations' names cover by half: of V, K and Q each equation has V, and K for each third source only."""
    lines, n = _numbered(spark, d), F.col("n")
    plain = F.concat(F.lit(" V"), n, F.lit(" = 2.5 * "), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("K_"), n)).otherwise("other"))
    found = evaluate.equation_symbols(F.lit(None).cast("string"), plain, F.concat(F.lit("("), n, F.lit(")")))
    expected = F.array(F.concat(F.lit("v"), n), F.concat(F.lit("k_"), n), F.concat(F.lit("Q "), n))
    sets = lines.groupBy("id").agg(F.collect_list(found).alias("found"), F.collect_list(expected).alias("expected"))
    return sets.select("id", (F.floor(evaluate.recall(F.col("found"), F.col("expected")) * 1e6 + 0.5) / 1e6).alias("recall"))


@query(f"SELECT id, 'medium' AS severity FROM ({_NUMBERED}) GROUP BY id HAVING count(DISTINCT CASE l_returnflag WHEN 'R' THEN 'hour' WHEN 'A' THEN 'day' END) > 1")
def mixed_time_scales(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose units divide by more than one time."""
    lines = _numbered(spark, d)
    unit = F.when(F.col("l_returnflag") == "R", F.when(F.col("n") % 2 == 0, "1/h").otherwise("g/L/hr")).when(F.col("l_returnflag") == "A", "mol/day").otherwise("g/L")
    rows = lines.select(F.col("id").alias("extraction_id"), F.col("n").alias("ordinal"), F.concat(F.lit("p"), "n").alias("symbol"), F.lit("p").alias("name"), unit.alias("unit"), F.lit("output").alias("role"), F.lit(1.0).alias("value"), F.lit("").alias("source_quote"))
    cards = rows.select("extraction_id").distinct().withColumn("corpus", F.lit(""))
    none = rows.limit(0).select("extraction_id", "ordinal", F.lit("").alias("latex"), F.lit("").alias("description"), F.array(F.lit("")).alias("variables_involved"))
    found = units.heuristic(cards, none, rows.limit(0), rows).where("rule = 'mixed_time_scales'")
    return found.select(F.col("extraction_id").alias("id"), "severity")


@query(f"SELECT id, n AS ordinal, CASE WHEN row_number() OVER (PARTITION BY id, l_suppkey % 2 ORDER BY n) = 1 THEN 'derivative' ELSE 'repeated' END AS kind FROM ({_NUMBERED})")
def first_derivatives(spark: SparkSession, d: str) -> DataFrame:
    """Of a card's equations for the derivative of one state, spelt in either case, the first counts; later ones are repeated."""
    n = buckets(spark, _t(spark, d, "lineitem").count())
    lines = bucketed(_numbered(spark, d, n).select(F.col("id").alias("extraction_id"), F.col("n").alias("ordinal"), "l_suppkey"), n, "extraction_id", "numbered_lines")
    state = F.when(F.col("l_suppkey") % 2 == 0, F.when(F.col("ordinal") % 2 == 0, "C").otherwise("c")).otherwise("B")
    eq = lines.select("extraction_id", "ordinal", F.concat(F.lit("d"), state, F.lit("/dt = -k * "), state).alias("latex"), F.lit("").alias("description"), F.lit("").alias("plaintext"))
    cards = lines.select("extraction_id").distinct()
    var = cards.select("extraction_id", F.explode(F.array(F.lit("C"), F.lit("B"))).alias("symbol")).withColumns({"ordinal": F.when(F.col("symbol") == "C", 0).otherwise(1), "unit": F.lit("g/L"), "role": F.lit("state"), "name": F.col("symbol")})
    par = cards.select("extraction_id", F.lit(0).alias("ordinal"), F.lit("k").alias("symbol"), F.lit("k").alias("name"), F.lit("1/h").alias("unit"), F.lit(0.5).alias("value"))
    return templates.match(eq, var, par).select(F.col("extraction_id").alias("id"), "ordinal", "kind")
