from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.operators import gold, silver


def test_metadata_is_dropped_if_there(spark):
    df = spark.createDataFrame([(1, "s")], "PROSPECTID long, _source string")
    assert silver.drop_metadata(df).columns == ["PROSPECTID"]
    assert silver.drop_metadata(df.select("PROSPECTID")).columns == ["PROSPECTID"]


def test_target_encoding(spark):
    grades = ["P1", "P2", "P3", "P4", None, "P9"]
    out = silver.encode_target(spark.createDataFrame([(g,) for g in grades], "Approved_Flag string")).collect()
    assert [r["risk_grade"] for r in out] == [1, 2, 3, 4, None, None]
    assert [r["default_risk"] for r in out] == [0, 0, 1, 1, 0, 0]


def test_sentinels(spark):
    na = K.NOT_APPLICABLE
    df = spark.createDataFrame(
        [(float(na), na, na, na, na, "x"), (0.5, 24, 40, 30, 2, "y"), (None, None, None, None, None, None)],
        "CC_utilization double, Age_Oldest_TL long, AGE int, max_deliq_6mts long, enq_L6m long, language string")
    first, second, third = silver.clean_sentinels(df).collect()
    assert (first["CC_utilization"], first["has_cc"], first["Age_Oldest_TL"], first["AGE"], first["max_deliq_6mts"]) == (
        0.0, 0, 9999, 9999, 0)
    assert first["enq_L6m"] == na  # outside the name patterns: stays
    assert first["language"] == "x"  # matches a pattern but holds text
    assert (second["CC_utilization"], second["has_cc"], second["Age_Oldest_TL"], second["AGE"]) == (0.5, 1, 24, 40)
    assert third["has_cc"] == 1 and third["CC_utilization"] is None
    assert dict(silver.clean_sentinels(df).dtypes)["AGE"] == "int"


def test_categories(spark):
    df = spark.createDataFrame(
        [(" mARried ", " post-graduate", " f ", " x "), (None, None, None, None), ("single", "Under Graduate", "m", "y")],
        "MARITALSTATUS string, EDUCATION string, GENDER string, last_prod_enq2 string")
    rows = [tuple(r) for r in silver.clean_categories(df).collect()]
    assert rows == [("Married", "POST_GRADUATE", "F", "x"), ("Nan", "OTHERS", "NAN", "nan"), ("Single", "OTHERS", "M", "y")]
    counts = {r["column_name"]: r for r in silver.category_counts(df, silver.clean_categories(df), ["GENDER"]).collect()}
    assert (counts["GENDER"]["distinct_before"], counts["GENDER"]["distinct_after"]) == (2, 3)


def test_join_suffixes_and_keys(spark):
    left = spark.createDataFrame([(1, 10, "l"), (2, 20, "l")], "PROSPECTID long, shared int, a string")
    right = spark.createDataFrame([(2, 99, "r"), (3, 98, "r")], "PROSPECTID long, shared int, b string")
    joined = silver.join_sources(left, right)
    assert sorted(joined.columns) == ["PROSPECTID", "a", "b", "shared_bank", "shared_cibil"]
    assert [(r["PROSPECTID"], r["shared_cibil"], r["shared_bank"]) for r in joined.collect()] == [(2, 20, 99)]


def raw_row(**changes):
    row = dict(PROSPECTID=1, Approved_Flag="P1", Credit_Score=700, NETMONTHLYINCOME=20000.0, Total_TL=4, Tot_Active_TL=1,
               Tot_Missed_Pmnt=2, Age_Oldest_TL=30, num_times_delinquent=1, num_times_30p_dpd=1, num_times_60p_dpd=1,
               Total_TL_opened_L6M=1, Gold_TL=1, Home_TL=0, PL_TL=None, CC_TL=2, Auto_TL=0, Consumer_TL=1)
    return {**row, **changes}


SCHEMA = ", ".join(f"{c} {'string' if c == 'Approved_Flag' else 'double' if c == 'NETMONTHLYINCOME' else 'long'}"
                   for c in raw_row())


def features(spark, **changes):
    row = raw_row(**changes)
    return silver.engineer_features(spark.createDataFrame([tuple(row.values())], SCHEMA)).first()


def test_features(spark):
    out = features(spark)
    assert (out["active_loan_ratio"], out["missed_payment_ratio"], out["score_per_income_lakh"]) == (0.25, 0.5, 3500.0)
    assert (out["delinquency_score"], out["recently_active"], out["loan_type_diversity"]) == (10, 1, 3)
    assert (out["income_tier"], out["cibil_band"], out["grade_band"]) == ("low", "very_good", "Low Risk")


def test_feature_guards(spark):
    for loans in (0, None, -1):
        assert features(spark, Total_TL=loans)["active_loan_ratio"] == 0.0
    for income in (0.0, None, -5.0):
        out = features(spark, NETMONTHLYINCOME=income)
        assert out["score_per_income_lakh"] == 0.0 and out["income_tier"] == "nan"
    assert features(spark, Approved_Flag=None)["grade_band"] == "Unknown"
    assert features(spark, Total_TL_opened_L6M=None)["recently_active"] == 0


def test_features_without_optional_columns(spark):
    df = spark.createDataFrame([tuple(raw_row().values())], SCHEMA).drop(
        "Total_TL_opened_L6M", "num_times_30p_dpd", "Gold_TL")
    out = silver.engineer_features(df).first()
    assert (out["recently_active"], out["delinquency_score"], out["loan_type_diversity"]) == (0, 7, 2)


def test_interactions(spark):
    df = spark.createDataFrame([(6, 12, 24, 3, 5, 2), (1, 10, 0, 0, 0, 0), (None, 1, 1, 1, 1, 1)],
                               "enq_L6m int, enq_L12m int, Age_Oldest_TL int, num_times_delinquent int, Total_TL int, "
                               "num_times_60p_dpd int")
    first, second, third = silver.interaction_features(df).collect()
    assert (first["enq_per_credit_year"], first["delinquency_rate"], first["enq_acceleration"],
            first["severe_delinquency_ratio"]) == (2.0, 0.5, 0.0, 0.5)
    assert second["enq_acceleration"] == 0.0
    assert third["enq_acceleration"] is None
    assert "enq_acceleration" not in silver.interaction_features(df.drop("enq_L12m")).columns


def test_operational_tables(spark):
    df = spark.createDataFrame([(1, 4, 23, 0, 0, 20, 1.0), (2, 4, 24, 0, 0, 20, 1.0), (3, 0, 50, 1, 0, 20, 1.0),
                                (4, 2, 10, 0, 1, 20, 1.0), (5, None, None, None, 0, 20, 1.0)],
                               "PROSPECTID long, enq_L6m long, Age_Oldest_TL long, num_times_60p_dpd long, "
                               "default_risk int, AGE int, NETMONTHLYINCOME double")
    tables = silver.operational_tables(df)
    assert [r["risk_segment"] for r in tables["risk_segments"].orderBy("borrower_id").collect()] == [
        "extreme_risk", "high_risk", "high_risk", "standard_risk", "standard_risk"]
    assert tables["delinquency_summary"].columns == ["borrower_id", "num_times_60p_dpd", "default_risk"]


def test_star_join_keeps_every_borrower_once(book):
    star = gold.star_join(*[book.gold(n) for n in ("fact_credit_risk", "dim_borrower", "dim_credit", "dim_loan_portfolio")])
    assert star.count() == book.silver().count()
    assert len(set(star.columns)) == len(star.columns)


def test_star_schema_has_nine_outputs(book):
    outputs = gold.star_schema(book.silver())
    assert len(outputs) == 9
    assert len(outputs["fact_credit_risk"].columns) == 26
    assert outputs["v_risk_by_age"].agg(F.sum("total_borrowers")).first()[0] == book.silver().count()
