"""Canonical tables from the driver's parquet files: catalogs, queries, turns, purchases, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vocab as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products.  Ratings come from integer cents of discount, so the value is exact in any order."""
    part = table(spark, sf_dir, "part")
    sold = (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey")
        .agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("cents"), F.count("*").alias("sold"))
    )
    name_words = F.split("p_name", " ")
    price = (
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("from "), F.col("p_retailprice").cast("string")))
        .when(F.col("p_size") % 7 == 0, F.lit("—"))
        .otherwise(F.col("p_retailprice").cast("string"))
    )
    return part.join(sold, part.p_partkey == sold.l_partkey).select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.array("p_brand", F.concat(F.lower("p_type"), F.lit(" grade "), F.col("p_name"))).alias("features"),
        F.array(F.concat(F.lit("A "), F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string"))).alias("description"),
        price.alias("price"),
        F.array(F.lit("Parts"), F.initcap("p_type"), F.initcap(name_words[1])).alias("categories"),
        F.create_map(
            F.lit("Size"), F.col("p_size").cast("string"), F.lit("Brand"), F.col("p_brand"),
            F.lit("Department"), F.col("p_type"), F.lit("Style"), name_words[0],
        ).alias("details"),
        F.greatest(F.lit(1.0), F.least(F.lit(5.0), 1 + 4 * (F.col("cents") / (F.col("sold") * 10.0)))).alias("average_rating"),
        F.col("sold").alias("rating_number"),
        F.col("p_brand").alias("store"),
    )


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as products with long text: title is the first line, description the whole text."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("parent_asin"),
        F.element_at(lines, 1).alias("title"),
        F.array().cast("array<string>").alias("features"),
        F.array("text").alias("description"),
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("from "), (F.col("n_chars") / 100.0).cast("string")))
        .otherwise((F.col("n_chars") / 100.0).cast("string")).alias("price"),
        F.array("lang", "source").alias("categories"),
        F.create_map(F.lit("Language"), F.col("lang")).alias("details"),
        F.lit(3.0).alias("average_rating"),
        F.col("n_chars").alias("rating_number"),
        F.col("source").alias("store"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"))


def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("int").alias("turn"),
        F.col("text").alias("message"))


def shopping_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as sessions of ten turns, one turn per order: the order's priority picks the form of the message.

    An eleventh order opens the customer's next session, so every order with lines is a turn of some session.
    """
    first_part = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = (
        orders.join(first_part, orders.o_orderkey == first_part.l_orderkey).join(part, "p_partkey")
        .withColumn("number", F.row_number().over(by_date) - 1)
        .withColumn("turn", F.col("number") % V.MAX_TURNS + 1)
    )
    session = F.concat_ws("-", F.col("o_custkey").cast("string"), F.floor(F.col("number") / V.MAX_TURNS).cast("string"))
    words = F.split("p_name", " ")
    category = F.concat(F.initcap("p_type"), F.lit(" "), F.initcap(words[1]))
    price = F.col("p_retailprice").cast("string")
    urgency = F.substring("o_orderpriority", 1, 1)
    opening = (
        F.when(urgency == "1", F.concat(F.lit("I'm looking for "), category, F.lit(". A key requirement is: "), words[0], F.lit(".")))
        .when(urgency == "2", F.concat(F.lit("I'm looking for "), category, F.lit(", but I'm still exploring.")))
        .when(urgency == "3", F.concat(F.lit("I'm looking for "), category, F.lit(". "), F.col("p_brand"), F.lit(" "), words[0]))
        .when(urgency == "4", F.concat(F.lit("I'm looking for "), category, F.lit(". A key requirement is: under $"), price, F.lit(".")))
        .otherwise(category)
    )
    asked = F.element_at(F.array(*[F.lit(a) for a in V.QUESTION_ATTRIBUTES]), (F.col("turn") - 2) % 7 + 1)
    reply = (
        F.when(urgency == "1", F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), words[0], F.lit(".")))
        .when(urgency.isin("2", "3"), F.concat(F.lit("For that, what matters is: "), F.col("p_brand"), F.lit("; budget around $"), price, F.lit(".")))
        .when(urgency == "4", F.concat(F.lit("I don't have a preference for "), asked, F.lit("; please use your judgment.")))
        .otherwise("Those options are not quite right yet. Ask me about one specific attribute.")
    )
    return rows.select(
        session.alias("session_id"),
        F.col("turn").cast("int").alias("turn"),
        F.when(F.col("turn") == 1, opening).otherwise(reply).alias("message"),
        F.when(F.col("turn") > 1, asked).alias("last_asked_attribute"),
        F.col("p_partkey").cast("string").alias("target"),
    )


def order_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session and turn of every line item as a careless client would send them: one session per customer, turns without end.

    Orders with several lines repeat their turn.
    """
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by_date).alias("turn"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(F.col("o_custkey").cast("string").alias("session_id"), "turn")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as purchase records, with the buyer's up to four earlier parts as history text.

    The history label saturates at four entries, so a bounded window frame carries all the information.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order = Window.partitionBy("o_custkey").orderBy(
        "o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .withColumn("seen", F.collect_list(F.col("l_partkey").cast("string")).over(order.rowsBetween(-4, -1)))
        .withColumn("purchase_no", F.row_number().over(order))
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("l_partkey").cast("string").alias("parent_asin"),
            F.least(F.lit(5.0), F.floor(F.col("l_quantity") / 10.0) + 1.0).alias("rating"),
            F.array_join("seen", " ").alias("history"),
            "purchase_no",
        )
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per user in time order."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(by_time))
