"""Borrower files derived from the sales tables.

The two raw inputs of a loan book - the bank's own loan counts and the bureau record -
are derived from customers, their orders and order lines. Order lines are by far the
largest input, so they are collapsed to one row per order before anything else is
joined: a customer with a third of all lines costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.constants import KEY, NOT_APPLICABLE
from loanloom.functions.columns import count_where, total
from loanloom.schemas import BANK, BUREAU
from loanloom.sources.tables import read_table

# ---- fixed values: product lines in alphabetical order and the loan type each stands for
PRODUCT_LINES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
LOAN_TYPES = {"ECONOMY": "Gold_TL", "SMALL": "Home_TL", "MEDIUM": "PL_TL", "LARGE": "CC_TL",
              "STANDARD": "Auto_TL", "PROMO": "Consumer_TL"}
# ---- fixed values: education text by market segment, untidy on purpose
EDUCATION_TEXT = {"AUTOMOBILE": " ssc", "BUILDING": "12th", "FURNITURE": "Graduate ",
                  "HOUSEHOLD": "post-graduate", "MACHINERY": "Under Graduate"}


def _product_code(product: Column) -> Column:
    """Numbers instead of names, so that the largest aggregate stays a hash aggregate."""
    chain = None
    for code, name in enumerate(PRODUCT_LINES):
        chain = (F.when(product == name, code) if chain is None
                 else chain.when(product == name, code))
    return chain


def _product_name(code: Column) -> Column:
    names = F.array(*[F.lit(name) for name in PRODUCT_LINES])
    return F.coalesce(F.get(names, code), F.lit("none"))


def order_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: everything its lines say about loans, enquiries and delays."""
    lines = read_table(spark, folder, "lineitem")
    parts = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), _product_code(F.col("p_type")).alias("product"))
    last_day = read_table(spark, folder, "orders").agg(F.max("o_orderdate")).scalar()

    loan = (F.col("l_linenumber") == 1) & (F.col("l_quantity") <= 25)
    returned = F.col("l_returnflag") == "R"
    late = returned & (F.col("l_discount") >= 0.09)
    age = F.datediff(last_day, F.col("l_shipdate"))
    said = {"loan": loan, "late": late, "missed": returned & (F.col("l_tax") >= 0.07),
            "late30": late & (F.col("l_tax") >= 0.04), "late60": late & (F.col("l_tax") >= 0.07),
            "half_year": age.between(0, 179), "year": age.between(0, 359)}
    # reduced to the bits of one number before the join, so that the widest shuffles carry next to nothing
    marks = lines.select(
        "l_orderkey", "l_partkey",
        total(F.when(holds, 1 << i).otherwise(0) for i, holds in enumerate(said.values())).alias("marks"),
        F.when(~returned & (age >= 0), age).alias("paid_ago"))
    # a line whose product is missing still counts, only not for a product. Lines of an order may lie anywhere: they are
    # brought together as they are, because counting them first would hold nearly every line as a group of many counts
    facts = marks.join(parts, "l_partkey", "left").drop("l_partkey").repartition("l_orderkey")

    def marked(name: str) -> Column:
        return F.col("marks").bitwiseAND(1 << list(said).index(name)) != 0

    def loans_of(product: str) -> Column:
        code = PRODUCT_LINES.index(product)
        return count_where(marked("loan") & (F.col("product") == code)).alias(LOAN_TYPES[product])

    return facts.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), count_where(marked("loan")).alias("loans"),
        *[loans_of(product) for product in LOAN_TYPES],
        *[count_where(marked(c)).alias(c)
          for c in ("missed", "late", "late30", "late60", "half_year", "year")],
        F.min("paid_ago").alias("paid_ago"),
        F.max("product").alias("last_product"), F.min("product").alias("first_product"))


def customer_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders."""
    orders = read_table(spark, folder, "orders")
    last_day = orders.agg(F.max("o_orderdate")).scalar()
    open_days = F.datediff(last_day, F.col("o_orderdate"))
    per_order = (order_summary(spark, folder)
                 .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                     "o_orderstatus", open_days.alias("open_days")), "l_orderkey"))

    def loans_if(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("loans")).otherwise(F.lit(0)))

    months = F.when(F.col("loans") > 0, F.floor(F.col("open_days") / F.lit(30.0)))
    summed = ["lines", "loans", *LOAN_TYPES.values(), "missed", "late", "late30", "late60",
              "half_year", "year"]
    return per_order.groupBy("o_custkey").agg(
        *[F.sum(c).alias(c) for c in summed],
        loans_if(F.col("o_orderstatus") == "O").alias("active"),
        loans_if(F.col("o_orderstatus") == "F").alias("closed"),
        loans_if(F.col("open_days") < 180).alias("opened"),
        F.max(months).alias("oldest"), F.min(months).alias("newest"),
        F.min("paid_ago").alias("paid_ago"),
        F.max("last_product").alias("last_product"), F.min("first_product").alias("first_product"))


def borrower_records(spark: SparkSession, folder: str) -> DataFrame:
    """All raw borrower columns, one row per customer, including those without orders."""
    customers = read_table(spark, folder, "customer")
    book = customers.join(customer_summary(spark, folder),
                          F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    def or_none(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(NOT_APPLICABLE)).cast("long")

    counts = book.withColumns({
        "Total_TL": n("loans"), "Tot_Active_TL": n("active"), "Tot_Closed_TL": n("closed"),
        "Total_TL_opened_L6M": n("opened"), "Tot_Missed_Pmnt": n("missed"),
        **{name: n(name) for name in LOAN_TYPES.values()},
        "Age_Oldest_TL": or_none("oldest"), "Age_Newest_TL": or_none("newest"),
        "enq_L6m": n("half_year"), "enq_L12m": n("year"), "tot_enq": n("lines"),
        "num_times_delinquent": n("late"), "num_times_30p_dpd": n("late30"),
        "num_times_60p_dpd": n("late60"), "time_since_recent_payment": or_none("paid_ago"),
    })
    used = F.pmod(key * 31, F.lit(100)) / F.lit(100.0)

    def utilisation(loans: str) -> Column:
        return F.when(F.col(loans) == 0, F.lit(float(NOT_APPLICABLE))).otherwise(used)

    worst = F.lit(30) * (1 + F.least(F.col("num_times_60p_dpd"), F.lit(2)))
    education = F.create_map(*[F.lit(x) for pair in EDUCATION_TEXT.items() for x in pair])
    described = counts.withColumns({
        KEY: key,
        "Secured_TL": F.col("Gold_TL") + F.col("Home_TL") + F.col("Auto_TL"),
        "Unsecured_TL": F.col("PL_TL") + F.col("CC_TL") + F.col("Consumer_TL"),
        "CC_utilization": utilisation("CC_TL"), "PL_utilization": utilisation("PL_TL"),
        **{f: (F.col(c) > 0).cast("int") for f, c in
           (("GL_Flag", "Gold_TL"), ("HL_Flag", "Home_TL"), ("PL_Flag", "PL_TL"), ("CC_Flag", "CC_TL"))},
        "max_deliq_6mts": F.when(F.col("num_times_delinquent") == 0, F.lit(NOT_APPLICABLE))
                           .otherwise(worst).cast("long"),
        "last_prod_enq2": _product_name(F.col("last_product")),
        "first_prod_enq2": _product_name(F.col("first_product")),
        "NETMONTHLYINCOME": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 8).otherwise(0.0),
        "AGE": (18 + F.pmod(key * 7919, F.lit(52))).cast("int"),
        "GENDER": F.when(key % 2 == 0, "M").otherwise(" f "),
        "MARITALSTATUS": F.when(F.col("c_nationkey") % 3 == 0, " mARried ").otherwise("Single"),
        "EDUCATION": education[F.col("c_mktsegment")],
        "Time_With_Curr_Empr": F.pmod(key * 31, F.lit(240)).cast("int"),
    })
    standing = F.when(F.col("Total_TL") == 0, 0).otherwise(F.least(F.col("Age_Oldest_TL"), F.lit(80)))
    raw_score = (790 - 30 * F.col("num_times_delinquent") - 25 * F.col("num_times_60p_dpd")
                 - 14 * F.col("enq_L6m") + standing + F.pmod(key * 104729, F.lit(61)) - 30)
    score = F.col("Credit_Score")
    graded = (described
              .withColumn("Credit_Score",
                          F.least(F.lit(900), F.greatest(F.lit(300), raw_score)).cast("int"))
              .withColumn("Approved_Flag", F.when(score >= 780, "P1").when(score >= 690, "P2")
                          .when(score >= 645, "P3").otherwise("P4")))
    return graded.select(*BANK.fieldNames(), *[c for c in BUREAU.fieldNames() if c != KEY])


def bank_file(records: DataFrame) -> DataFrame:
    return records.select(*BANK.fieldNames())


def bureau_file(records: DataFrame) -> DataFrame:
    return records.select(*BUREAU.fieldNames())
