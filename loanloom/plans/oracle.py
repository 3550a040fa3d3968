"""SQL cross-checks by query name, for DuckDB over the same raw tables."""

from __future__ import annotations

from loanloom.constants import CLUSTER_FEATURES, FEATURES, WEIGHT_MULTIPLES
from loanloom.plans.oracle_base import FACT, RAW, SCORED, SILVER, r, with_tables

ORACLE: dict[str, str] = {}

BANK = """PROSPECTID, Total_TL, Tot_Active_TL, Tot_Closed_TL, Total_TL_opened_L6M, Tot_Missed_Pmnt, Gold_TL,
 Home_TL, PL_TL, CC_TL, Auto_TL, Consumer_TL, Secured_TL, Unsecured_TL, Age_Oldest_TL, Age_Newest_TL,
 enq_L6m, enq_L12m, tot_enq"""
BUREAU = """PROSPECTID, Approved_Flag, Credit_Score, AGE, GENDER, MARITALSTATUS, EDUCATION,
 num_times_delinquent, num_times_30p_dpd, num_times_60p_dpd, max_deliq_6mts, time_since_recent_payment,
 last_prod_enq2, first_prod_enq2, Time_With_Curr_Empr, GL_Flag, HL_Flag, PL_Flag, CC_Flag"""
USED = f"{r('CC_utilization')} AS CC_utilization, {r('PL_utilization')} AS PL_utilization"
INCOME = f"{r('NETMONTHLYINCOME')} AS NETMONTHLYINCOME"
# floating columns of the silver table, rounded in place
SILVER_DOUBLES = ("CC_utilization", "PL_utilization", "NETMONTHLYINCOME", "active_loan_ratio",
                  "missed_payment_ratio", "score_per_income_lakh")
SILVER_ROUNDED = ", ".join(f"{r(c)} AS {c}" for c in SILVER_DOUBLES)


def raw(name, body):
    ORACLE[name] = with_tables(RAW, body)


def silver(name, body):
    ORACLE[name] = with_tables(SILVER, body)


def scored(name, body):
    ORACLE[name] = with_tables(SCORED, body)


def fact(name, body):
    ORACLE[name] = with_tables(FACT, body)


def pct(n, d):
    return r(f"100.0::DOUBLE * ({n}) / nullif({d}, 0)")


# ---- source files and cleaning ------------------------------------------------------------
raw("bank_file", f"SELECT {BANK}, {USED} FROM graded")
raw("bureau_file", f"SELECT {BUREAU}, {INCOME} FROM graded")
raw("borrower_records", f"SELECT {BANK}, {USED}, Credit_Score, Approved_Flag FROM graded")
raw("drop_metadata", f"SELECT {BANK}, {USED} FROM graded")
raw("tagged_rows", """SELECT 'kaggle_cibil_external' AS _source, count(*) AS row_count,
 1::BIGINT AS ingest_times FROM graded""")
raw("encoded_target", """SELECT PROSPECTID, Approved_Flag, substr(Approved_Flag, 2, 1)::INTEGER AS risk_grade,
 (Approved_Flag >= 'P3')::INTEGER AS default_risk FROM graded""")
raw("clean_sentinels", f"""SELECT {BANK.replace("Age_Oldest_TL, Age_Newest_TL,", "")},
 (CASE Age_Oldest_TL WHEN -99999 THEN 9999 ELSE Age_Oldest_TL END)::BIGINT AS Age_Oldest_TL,
 (CASE Age_Newest_TL WHEN -99999 THEN 9999 ELSE Age_Newest_TL END)::BIGINT AS Age_Newest_TL,
 {r("CASE WHEN CC_TL = 0 THEN 0 ELSE CC_utilization END")} AS CC_utilization,
 {r("CASE WHEN PL_TL = 0 THEN 0 ELSE PL_utilization END")} AS PL_utilization,
 (CC_TL > 0)::INTEGER AS has_cc, (PL_TL > 0)::INTEGER AS has_pl FROM graded""")
silver("clean_categories", """SELECT PROSPECTID, MARITALSTATUS, EDUCATION, GENDER, last_prod_enq2, first_prod_enq2
 FROM tidy""")
silver("category_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM graded) AS distinct_before, "
    f"(SELECT count(DISTINCT {c}) FROM tidy) AS distinct_after"
    for c in ("MARITALSTATUS", "EDUCATION", "GENDER", "last_prod_enq2", "first_prod_enq2")))
silver("silver_features", f"SELECT * EXCLUDE ({', '.join(SILVER_DOUBLES)}), {SILVER_ROUNDED} FROM silver")
silver("interaction_features", f"""SELECT PROSPECTID,
 {r("enq_L6m / (Age_Oldest_TL / 12.0::DOUBLE + 1)")} AS enq_per_credit_year,
 {r("num_times_delinquent / (Total_TL + 1.0::DOUBLE)")} AS delinquency_rate,
 {r("CASE WHEN 2 * enq_L6m > enq_L12m THEN enq_L6m - enq_L12m / 2.0::DOUBLE ELSE 0 END")} AS enq_acceleration,
 {r("num_times_60p_dpd / (num_times_delinquent + 1.0::DOUBLE)")} AS severe_delinquency_ratio FROM silver""")
raw("median_fill", f"""SELECT PROSPECTID,
 {r("coalesce(nullif(CC_utilization, -99999), (SELECT median(CC_utilization) FROM graded WHERE CC_TL > 0))")}
   AS CC_utilization,
 {r('''coalesce(nullif(Age_Oldest_TL, -99999),
      (SELECT median(Age_Oldest_TL) FROM graded WHERE Total_TL > 0))''')} AS Age_Oldest_TL FROM graded""")

GAPPY = {"CC_utilization": "CC_TL > 0", "PL_utilization": "PL_TL > 0", "Age_Oldest_TL": "Total_TL > 0", "Age_Newest_TL": "Total_TL > 0"}
raw("median_fill_all", "SELECT PROSPECTID, " + ", ".join(
    r(f"coalesce(nullif({c}, -99999), (SELECT median({c}) FROM graded WHERE {known}))") + f" AS {c}" for c, known in GAPPY.items())
    + " FROM graded")

# ---- star schema ----------------------------------------------------------------------------
AGE_BAND = """CASE WHEN AGE >= 55 THEN '55_plus' WHEN AGE >= 45 THEN '45_to_54' WHEN AGE >= 35 THEN '35_to_44'
 WHEN AGE >= 25 THEN '25_to_34' ELSE 'under_25' END"""
DIM_B = f"""PROSPECTID AS borrower_id, AGE AS age, GENDER AS gender, MARITALSTATUS AS marital_status,
 EDUCATION AS education, {r('NETMONTHLYINCOME')} AS monthly_income_inr, income_tier,
 Time_With_Curr_Empr AS months_with_employer, {AGE_BAND} AS age_band"""
DIM_C_NEW = """cibil_band, credit_history_months, num_times_delinquent AS total_delinquencies,
 num_times_30p_dpd AS times_30dpd, num_times_60p_dpd AS times_60dpd, delinquency_score,
 Tot_Missed_Pmnt AS total_missed_payments, time_since_recent_payment, tot_enq AS total_enquiries,
 enq_L6m AS enquiries_last_6m, enq_L12m AS enquiries_last_12m, last_prod_enq2 AS last_product_enquired,
 first_prod_enq2 AS first_product_enquired"""
DIM_L_NEW = """Total_TL AS total_loans_ever, Tot_Active_TL AS active_loans, Tot_Closed_TL AS closed_loans,
 Gold_TL AS gold_loans, Home_TL AS home_loans, PL_TL AS personal_loans, CC_TL AS credit_card_loans,
 Auto_TL AS auto_loans, Consumer_TL AS consumer_loans, Secured_TL AS secured_loans,
 Unsecured_TL AS unsecured_loans, recently_active"""
silver("dim_borrower", f"SELECT {DIM_B} FROM silver")
silver("dim_credit", f"SELECT PROSPECTID AS borrower_id, Credit_Score AS cibil_score, {DIM_C_NEW} FROM silver")
silver("dim_loan_portfolio", f"""SELECT PROSPECTID AS borrower_id, {DIM_L_NEW},
 {r('active_loan_ratio')} AS active_loan_ratio, loan_type_diversity, GL_Flag AS has_gold_loan,
 HL_Flag AS has_home_loan, PL_Flag AS has_personal_loan, CC_Flag AS has_credit_card FROM silver""")
FACT_DOUBLES = ("monthly_income_inr", "missed_payment_ratio", "active_loan_ratio", "score_per_income_lakh")
FACT_ROUNDED = ", ".join(f"{r('f.' + c)} AS {c}" for c in FACT_DOUBLES)
fact("fact_credit_risk", f"SELECT f.* EXCLUDE ({', '.join(FACT_DOUBLES)}), {FACT_ROUNDED} FROM fact f")
fact("star_join", f"""SELECT f.* EXCLUDE ({', '.join(FACT_DOUBLES)}), {FACT_ROUNDED},
 d.* EXCLUDE (PROSPECTID) FROM fact f JOIN (SELECT PROSPECTID, Time_With_Curr_Empr AS months_with_employer,
 {DIM_C_NEW.replace("cibil_band, credit_history_months,", "").replace(" delinquency_score,", "")},
 {DIM_L_NEW}, CC_Flag AS has_credit_card FROM silver) d ON d.PROSPECTID = f.borrower_id""")
RATE = f"{r('avg(default_risk) * 100')} AS default_rate_pct"
VIEW = f"""count(*) AS total_borrowers, {RATE}, {r('avg(cibil_score)')} AS avg_cibil_score,
 {r('avg(monthly_income_inr)')} AS avg_income_inr"""
LOANS = f"{r('avg(total_loans)')} AS avg_total_loans"
fact("risk_by_score_band", f"""SELECT cibil_band, {VIEW}, sum(default_risk)::BIGINT AS high_risk_count
 FROM fact GROUP BY cibil_band""")
fact("risk_by_income", f"SELECT income_tier, {VIEW}, {LOANS} FROM fact GROUP BY income_tier")
fact("risk_by_age", f"SELECT age_band, {VIEW} FROM fact GROUP BY age_band")
fact("risk_by_gold_loan", f"SELECT has_gold_loan, {VIEW}, {LOANS} FROM fact GROUP BY has_gold_loan")
fact("risk_by_education", f"SELECT education, {VIEW} FROM fact GROUP BY education")
SEGMENT = """CASE WHEN least(enq_L6m, 4) = 4 AND Age_Oldest_TL < 24 THEN 'extreme_risk'
 WHEN greatest(enq_L6m - 2, num_times_60p_dpd) >= 1 THEN 'high_risk' ELSE 'standard_risk' END"""
silver("risk_segments", f"""SELECT borrower_id, {SEGMENT} AS risk_segment, default_risk, AGE, {INCOME} FROM b""")
silver("delinquency_summary", f"""SELECT borrower_id, num_times_delinquent, num_times_30p_dpd, num_times_60p_dpd,
 Tot_Missed_Pmnt, {r('missed_payment_ratio')} AS missed_payment_ratio, delinquency_score, default_risk FROM b""")

# ---- report library ----------------------------------------------------------------------------
DEFAULTS = "sum(default_risk)::BIGINT AS defaults"
silver("portfolio_health", f"""SELECT count(*) AS total_borrowers, sum(default_risk)::BIGINT AS total_defaults,
 {RATE}, {r('avg(NETMONTHLYINCOME)')} AS avg_monthly_income, {r('avg(AGE)')} AS avg_age,
 {r('avg(Total_TL)')} AS avg_total_loans, {r('avg(active_loan_ratio) * 100')} AS avg_active_loan_ratio_pct,
 {r('avg(num_times_delinquent)')} AS avg_delinquencies,
 count(*) FILTER (num_times_delinquent > 0) AS ever_delinquent_count,
 {pct('count(*) FILTER (num_times_delinquent > 0)', 'count(*)')} AS ever_delinquent_pct,
 {r('avg(enq_L6m)')} AS avg_enquiries_6m, {r('avg(enq_L12m)')} AS avg_enquiries_12m FROM b""")
silver("default_by_segment", f"""SELECT risk_segment, count(*) AS borrower_count, {DEFAULTS}, {RATE},
 {r('avg(NETMONTHLYINCOME)')} AS avg_income, {r('avg(AGE)')} AS avg_age,
 {pct('count(*)', '(SELECT count(*) FROM b)')} AS pct_of_portfolio
 FROM (SELECT *, {SEGMENT} AS risk_segment FROM b) GROUP BY risk_segment""")
silver("enquiry_lift", f"""SELECT CASE WHEN enq_L6m = 1 THEN '1 enquiry' WHEN enq_L6m IN (0, 2, 3)
   THEN enq_L6m || ' enquiries' WHEN enq_L6m IN (4, 5) THEN '4-5 enquiries' ELSE '6+ enquiries' END AS enquiry_band,
 enq_L6m AS raw_enq_L6m, count(*) AS borrower_count, {DEFAULTS}, {RATE},
 {r('avg(default_risk) / (SELECT nullif(avg(default_risk), 0) FROM b)')} AS lift_over_baseline
 FROM b GROUP BY enq_L6m""")
silver("delinquency_funnel", f"""SELECT stage, "count", {pct('"count"', 'n')} AS pct_of_portfolio,
 CASE WHEN place >= 3 THEN {pct('"count"', 'prev')} END AS transition_rate_from_prev FROM (
   SELECT *, first_value("count") OVER (ORDER BY place) AS n, lag("count") OVER (ORDER BY place) AS prev FROM (
     SELECT 1 AS place, 'Active Portfolio' AS stage, count(*) AS "count" FROM b
     UNION ALL SELECT 2, 'Ever 30+ DPD', count(*) FROM b WHERE num_times_delinquent > 0
     UNION ALL SELECT 3, 'Ever 60+ DPD', count(*) FROM b WHERE num_times_60p_dpd > 0
     UNION ALL SELECT 4, 'Confirmed Default', count(*) FROM b WHERE default_risk = 1))""")
HISTORY = """CASE WHEN Age_Oldest_TL < 12 THEN '{0}' WHEN Age_Oldest_TL < 24 THEN '{1}'
 WHEN Age_Oldest_TL < 48 THEN '{2}' WHEN Age_Oldest_TL < 96 THEN '{3}' ELSE '{4}' END"""
silver("history_vs_default", f"""WITH g AS (SELECT {HISTORY.format("Under 1 year", "1-2 years", "2-4 years",
   "4-8 years", "8+ years")} AS credit_history_band, * FROM b WHERE Age_Oldest_TL IS NOT NULL),
 m AS (SELECT min(rate) AS best, sum(n) AS n FROM
   (SELECT avg(default_risk) AS rate, count(*) AS n FROM g GROUP BY credit_history_band))
 SELECT credit_history_band, count(*) AS borrower_count, {DEFAULTS}, {RATE},
 {r('avg(enq_L6m)')} AS avg_recent_enquiries, {r('avg(num_times_delinquent)')} AS avg_delinquencies,
 {pct('count(*)', 'any_value(m.n)')} AS pct_of_portfolio,
 {r('avg(default_risk) / nullif(any_value(m.best), 0)')} AS relative_risk_vs_safest
 FROM g CROSS JOIN m GROUP BY credit_history_band""".replace("WITH g AS", ", g AS", 1))
RULES = (("High Enquiry (4+ in 6m)", "enq_L6m >= 4"), ("Thin File (<2yr history)", "Age_Oldest_TL < 24"),
         ("Severe Delinquency (60+ DPD ever)", "num_times_60p_dpd >= 1"),
         ("Extreme Risk (Rule 1 AND Rule 2)", "enq_L6m >= 4 AND Age_Oldest_TL < 24"))
silver("high_risk_rules", " UNION ALL ".join(
    f"""SELECT '{name}' AS policy_rule, count(*) AS flagged_count,
 {pct('count(*)', '(SELECT count(*) FROM b)')} AS pct_of_portfolio,
 {r('avg(default_risk) * 100')} AS default_rate_in_segment FROM b WHERE {rule}""" for name, rule in RULES))
INCOME_CASE = """CASE WHEN NETMONTHLYINCOME < 10000 THEN '{0}'
 WHEN NETMONTHLYINCOME >= 10000 AND NETMONTHLYINCOME <= 19999 THEN '{1}'
 WHEN NETMONTHLYINCOME >= 20000 AND NETMONTHLYINCOME <= 34999 THEN '{2}'
 WHEN NETMONTHLYINCOME >= 35000 AND NETMONTHLYINCOME <= 59999 THEN '{3}' ELSE '{4}' END"""
silver("income_vs_default", f"""SELECT {INCOME_CASE.format("1. <10k", "2. 10-20k", "3. 20-35k", "4. 35-60k",
   "5. 60k+")} AS income_band, count(*) AS borrower_count, {RATE}, {r('avg(enq_L6m)')} AS avg_enquiries_6m,
 {r('avg(num_times_delinquent)')} AS avg_delinquencies, {r('avg(Age_Oldest_TL)')} AS avg_credit_history_months,
 {r('100 * avg(default_risk) FILTER (enq_L6m >= 4)')} AS default_rate_high_enquiry_pct,
 {r('100 * avg(default_risk) FILTER (enq_L6m <= 1)')} AS default_rate_low_enquiry_pct
 FROM b WHERE NETMONTHLYINCOME IS NOT NULL GROUP BY income_band""")
silver("gold_loan_buckets", f"""SELECT CASE Gold_TL WHEN 0 THEN 'No gold loans' WHEN 1 THEN '1 gold loan'
   WHEN 2 THEN '2 gold loans' ELSE '3+ gold loans' END AS gold_loan_bucket,
 count(*) AS borrower_count, {DEFAULTS}, {RATE}, {r('avg(NETMONTHLYINCOME)')} AS avg_monthly_income,
 {r('avg(enq_L6m)')} AS avg_recent_enquiries, {r('avg(num_times_delinquent)')} AS avg_delinquencies,
 {r('avg(Total_TL)')} AS avg_total_loans, {r('avg(active_loan_ratio) * 100')} AS avg_active_ratio_pct,
 {pct('count(*)', '(SELECT count(*) FROM b WHERE Gold_TL IS NOT NULL)')} AS pct_of_portfolio
 FROM b WHERE Gold_TL IS NOT NULL GROUP BY gold_loan_bucket""")


def score(enquiries, delays, missed, active):
    return (f"enq_L6m * {enquiries}::DOUBLE + num_times_delinquent * {delays}::DOUBLE "
            f"+ missed_payment_ratio * {missed}::DOUBLE + active_loan_ratio * {active}::DOUBLE")


silver("early_intervention", f"""SELECT borrower_id, enq_L6m AS recent_enquiries_6m,
 num_times_delinquent AS total_delinquencies, num_times_60p_dpd AS serious_delinquencies,
 {r('missed_payment_ratio')} AS missed_payment_ratio, {r('active_loan_ratio')} AS active_loan_ratio,
 Age_Oldest_TL AS credit_history_months, {r('NETMONTHLYINCOME')} AS monthly_income,
 {r('s')} AS intervention_score, CASE WHEN hot AND Age_Oldest_TL < 24 THEN 'EXTREME — Act immediately'
   WHEN hot OR num_times_60p_dpd >= 1 THEN 'HIGH — Contact this week'
   WHEN greatest(enq_L6m, num_times_delinquent) >= 2 THEN 'MEDIUM — Monitor closely'
   ELSE 'LOW — Standard monitoring' END AS intervention_priority
 FROM (SELECT *, enq_L6m >= 4 AS hot, {score(0.30, 0.25, 0.25, 0.20)} AS s FROM b)
 WHERE default_risk = 0 AND (enq_L6m >= 3 OR num_times_delinquent >= 2 OR missed_payment_ratio >= 0.2::DOUBLE
   OR (enq_L6m = 2 AND Age_Oldest_TL < 24)) ORDER BY s DESC, borrower_id LIMIT 500""")
silver("policy_impact", f"""SELECT n AS total_borrowers, d AS baseline_defaults, {pct('d', 'n')} AS baseline_npa_pct,
 p1 AS defaults_flagged_policy1, {pct('p1', 'd')} AS pct_defaults_caught_policy1,
 p2 AS defaults_flagged_policy2, {pct('p2', 'd')} AS pct_defaults_caught_policy2,
 {r('p3 / 5.0::DOUBLE')} AS defaults_saved_policy3,
 {pct('d - any12 * 0.7::DOUBLE - p3 * 0.2::DOUBLE', 'n')} AS estimated_npa_after_policies FROM (
 SELECT (SELECT count(*) FROM b) AS n, count(*) AS d, count(*) FILTER (enq_L6m >= 4) AS p1,
  count(*) FILTER (Age_Oldest_TL < 24) AS p2, count(*) FILTER (enq_L6m >= 4 OR Age_Oldest_TL < 24) AS any12,
  count(*) FILTER (num_times_delinquent >= 1 AND num_times_60p_dpd = 0) AS p3 FROM b WHERE default_risk = 1)""")

# ---- quality and profile ----------------------------------------------------------------------------
CHECKS = [(f"{c}_nulls", f"(SELECT count(*) FROM silver WHERE {c} IS NULL)", "= 0") for c in
          ("PROSPECTID", "Credit_Score", "default_risk", "NETMONTHLYINCOME", "AGE")] + [
    ("score_out_of_range", """(SELECT count(*) FROM silver WHERE Credit_Score IS NULL OR Credit_Score < 300
       OR Credit_Score > 900)""", "= 0"),
    ("target_not_binary", "(SELECT count(*) FROM silver WHERE default_risk NOT IN (0, 1))", "= 0"),
    ("risky_minus_safe_score", """((SELECT avg(Credit_Score) FROM silver WHERE default_risk = 1)
       - (SELECT avg(Credit_Score) FROM silver WHERE default_risk = 0))""", "< 0"),
    ("grade_band_unknown", "(SELECT count(*) FROM silver WHERE grade_band = 'Unknown')", "= 0"),
    ("negative_income", "(SELECT count(*) FROM silver WHERE NETMONTHLYINCOME < 0)", "= 0"),
    ("duplicate_keys", "(SELECT count(*) - count(DISTINCT PROSPECTID) FROM silver)", "= 0")]
CHECK_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, {value} {test} AS passed, {r(value)} AS value" for name, value, test in CHECKS)
silver("quality_checks", CHECK_ROWS)
silver("quality_verdict", f"SELECT bool_and(passed) AS all_passed FROM ({CHECK_ROWS})")
raw("duplicate_keys", "SELECT count(*) - count(DISTINCT PROSPECTID) AS duplicate_keys FROM graded")
silver("encoding_direction", f"""SELECT {r('hi')} AS risky_mean_score, {r('lo')} AS safe_mean_score, hi < lo AS encoding_ok
 FROM (SELECT avg(Credit_Score) FILTER (default_risk = 1) AS hi, avg(Credit_Score) FILTER (default_risk = 0) AS lo
 FROM silver)""")
RECONCILE = """SELECT count(l.k) AS left_keys, count(x.k) AS right_keys,
 count(*) FILTER (l.k IS NOT NULL AND x.k IS NOT NULL) AS matched, count(*) FILTER (x.k IS NULL) AS only_left,
 count(*) FILTER (l.k IS NULL) AS only_right, CASE WHEN count(*) FILTER (l.k IS NULL OR x.k IS NULL) = 0 THEN 'perfect'
   WHEN count(*) FILTER (l.k = x.k) > 0 THEN 'partial' ELSE 'none' END AS verdict
 FROM (SELECT DISTINCT {0} AS k FROM {1}) l FULL JOIN (SELECT DISTINCT {2} AS k FROM {3}) x ON l.k = x.k"""
raw("key_reconciliation", RECONCILE.format("PROSPECTID", "graded", "PROSPECTID", "raw"))
ORACLE["customer_order_keys"] = RECONCILE.format("c_custkey", "customer", "o_custkey", "orders")
BANK_NAMES = [c.strip() for c in BANK.replace("\n", " ").split(",")] + ["CC_utilization", "PL_utilization"]
BUREAU_NUMBERS = ["Credit_Score", "AGE", "NETMONTHLYINCOME", "num_times_delinquent", "num_times_30p_dpd",
                  "num_times_60p_dpd", "max_deliq_6mts", "time_since_recent_payment", "Time_With_Curr_Empr",
                  "GL_Flag", "HL_Flag", "PL_Flag", "CC_Flag"]
SILVER_NUMBERS = ["risk_grade", "default_risk", "has_cc", "has_pl", "active_loan_ratio", "missed_payment_ratio",
                  "credit_history_months", "score_per_income_lakh", "delinquency_score", "recently_active",
                  "loan_type_diversity"]


def marked(table, names):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} = -99999) AS marked_rows,
 count(*) FILTER ({c} = -99999) > 0 AS has_marker FROM {table}""" for c in names)


raw("sentinel_scan", marked("graded", [*BANK_NAMES, *BUREAU_NUMBERS]))
silver("sentinels_left", marked("silver", [*BANK_NAMES, *BUREAU_NUMBERS, *SILVER_NUMBERS]))
BUREAU_TYPES = {**{c: "bigint" for c in ("PROSPECTID", "num_times_delinquent", "num_times_30p_dpd",
                                         "num_times_60p_dpd", "max_deliq_6mts", "time_since_recent_payment")},
                **{c: "int" for c in ("Credit_Score", "AGE", "Time_With_Curr_Empr", "GL_Flag", "HL_Flag",
                                      "PL_Flag", "CC_Flag")},
                **{c: "string" for c in ("Approved_Flag", "GENDER", "MARITALSTATUS", "EDUCATION",
                                         "last_prod_enq2", "first_prod_enq2")}, "NETMONTHLYINCOME": "double"}
raw("column_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type, {pct(f'count(*) - count({c})', 'count(*)')} AS null_pct
 FROM graded""" for c, t in BUREAU_TYPES.items()))
ORACLE["events_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {pct(f'count(*) - count({c})', 'count(*)')} AS null_pct FROM events"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))
raw("sample_scan", "SELECT least(count(*), 5000) AS row_count FROM graded")


def described(column):
    return f"""SELECT Approved_Flag, count({column}) AS count, {r(f'avg({column})')} AS mean,
 {r(f'stddev_samp({column})')} AS std, {r(f'min({column})')} AS min, {r(f'max({column})')} AS max,
 {r(f'quantile_cont({column}::DOUBLE, 0.25)')} AS q25, {r(f'quantile_cont({column}::DOUBLE, 0.5)')} AS median,
 {r(f'quantile_cont({column}::DOUBLE, 0.75)')} AS q75 FROM silver GROUP BY Approved_Flag"""


silver("describe_score_by_grade", described("Credit_Score"))
silver("describe_income_by_grade", described("NETMONTHLYINCOME"))
silver("describe_age_by_grade", described("AGE"))
silver("describe_by_grade", " UNION ALL ".join(f"SELECT '{c}' AS column_name, * FROM ({described(c)})"
                                               for c in ("Credit_Score", "NETMONTHLYINCOME", "AGE")))
raw("grade_counts", "SELECT Approved_Flag, count(*) AS count FROM graded GROUP BY Approved_Flag")
silver("grade_means", f"""SELECT Approved_Flag, {r('avg(num_times_delinquent)')} AS avg_num_times_delinquent,
 {r('avg(num_times_60p_dpd)')} AS avg_num_times_60p_dpd, {r('avg(Tot_Missed_Pmnt)')} AS avg_Tot_Missed_Pmnt
 FROM silver GROUP BY Approved_Flag""")
silver("best_vs_worst_grade", " UNION ALL ".join(
    f"""SELECT '{c}' AS measure, {r(f"avg({c}) FILTER (Approved_Flag = 'P1')")} AS mean_P1,
 {r(f"avg({c}) FILTER (Approved_Flag = 'P4')")} AS mean_P4 FROM silver"""
    for c in ("Credit_Score", "NETMONTHLYINCOME", "num_times_delinquent", "Tot_Missed_Pmnt", "Total_TL")))
ORACLE["dictionary_search"] = """SELECT doc_id, lang FROM documents
 WHERE regexp_matches(concat_ws(chr(10), text, lang, source), 'License|Copyright|Rights Reserved', 'i')"""
KEYS = """count(*) AS row_count, count(DISTINCT PROSPECTID) AS distinct_keys, min(PROSPECTID) AS min_key,
 max(PROSPECTID) AS max_key, count(*) - count(DISTINCT PROSPECTID) AS duplicate_keys"""
raw("ingest_summary_bank", f"SELECT {KEYS} FROM graded")
raw("ingest_summary_bureau", f"""SELECT {KEYS}, min(Credit_Score) AS min_Credit_Score,
 max(Credit_Score) AS max_Credit_Score, {r('avg(Credit_Score)')} AS mean_Credit_Score,
 {r('min(NETMONTHLYINCOME)')} AS min_NETMONTHLYINCOME, {r('max(NETMONTHLYINCOME)')} AS max_NETMONTHLYINCOME,
 {r('avg(NETMONTHLYINCOME)')} AS mean_NETMONTHLYINCOME FROM graded""")
ORACLE["application_summary"] = f"""SELECT count(*) AS row_count,
 {pct("count(*) FILTER (o_orderstatus = 'F')", 'count(*)')} AS disbursed_pct,
 {r('min(o_totalprice)')} AS min_amount, {r('max(o_totalprice)')} AS max_amount FROM orders"""

# ---- portfolio -----------------------------------------------------------------------------------------
EAD, LOSS = "NETMONTHLYINCOME * 12", "predicted_pd * 0.45::DOUBLE * (NETMONTHLYINCOME * 12)"
scored("rule_pd", f"SELECT PROSPECTID, {r('predicted_pd')} AS predicted_pd FROM scored")
scored("portfolio_summary", f"""SELECT count(*) AS total_borrowers, sum(default_risk)::BIGINT AS total_defaults,
 {RATE}, count(*) FILTER (default_risk = 0) AS safe_borrowers, {r('avg(predicted_pd) * 100')} AS avg_predicted_pd_pct,
 count(*) FILTER (predicted_pd >= 0.5) AS high_risk_count,
 {pct('count(*) FILTER (predicted_pd >= 0.5)', 'count(*)')} AS high_risk_pct,
 count(*) FILTER (predicted_pd >= 0.25 AND predicted_pd < 0.5) AS medium_risk_count,
 count(*) FILTER (predicted_pd < 0.25) AS low_risk_count, {r(f'sum({EAD}) / 1e7')} AS total_ead_cr,
 {r(f'sum({LOSS}) / 1e7')} AS expected_loss_cr, {r(f'100 * sum({LOSS}) / sum({EAD})')} AS expected_loss_rate_pct
 FROM scored""")
scored("headline_kpis", f"""SELECT count(*) AS borrowers, {r('avg(default_risk)')} AS default_rate,
 {r('avg((predicted_pd < 0.5)::INTEGER)')} AS approval_rate, {r('avg(predicted_pd)')} AS avg_pd,
 count(*) FILTER (predicted_pd >= 0.5) AS high_risk_count, {r(f'sum({LOSS}) / 1e7')} AS expected_loss_cr,
 {r(f'sum({EAD}) / 1e7')} AS ead_cr FROM scored""")
scored("pd_band_distribution", f"""SELECT name AS risk_band, place AS band_order, count(predicted_pd) AS count,
 {pct('count(predicted_pd)', '(SELECT count(*) FROM scored)')} AS pct_of_portfolio,
 {r('coalesce(avg(predicted_pd), 0) * 100')} AS avg_pd_pct
 FROM (VALUES ('Low Risk', 0, 0.0, 0.25), ('Medium Risk', 1, 0.25, 0.5), ('High Risk', 2, 0.5, 1.0)) v(name, place, lo, hi)
 LEFT JOIN scored ON predicted_pd >= lo AND predicted_pd < hi GROUP BY name, place""")
AGE_CUT = """CASE WHEN AGE > 18 AND AGE <= 25 THEN '18-25' WHEN AGE > 25 AND AGE <= 35 THEN '26-35'
 WHEN AGE > 35 AND AGE <= 45 THEN '36-45' WHEN AGE > 45 AND AGE <= 55 THEN '46-55'
 WHEN AGE > 55 AND AGE <= 75 THEN '55+' END"""
INCOME_CUT = """CASE WHEN NETMONTHLYINCOME > 0 AND NETMONTHLYINCOME <= 10000 THEN '<10k'
 WHEN NETMONTHLYINCOME > 10000 AND NETMONTHLYINCOME <= 20000 THEN '10-20k'
 WHEN NETMONTHLYINCOME > 20000 AND NETMONTHLYINCOME <= 35000 THEN '20-35k'
 WHEN NETMONTHLYINCOME > 35000 AND NETMONTHLYINCOME <= 60000 THEN '35-60k'
 WHEN NETMONTHLYINCOME > 60000 AND NETMONTHLYINCOME <= 500000 THEN '60k+' END"""


def rates(segment):
    return f"""SELECT {segment} AS segment, count(*) AS count, {DEFAULTS}, {RATE},
 {pct('sum(default_risk)', '(SELECT sum(default_risk) FROM b)')} AS risk_contribution_pct,
 {pct('count(*)', '(SELECT count(*) FROM b)')} AS pct_of_portfolio FROM b WHERE {segment} IS NOT NULL GROUP BY 1"""


silver("segment_rates_age", rates(AGE_CUT))
silver("segment_rates_income", rates(INCOME_CUT))
silver("segment_rates_tier", rates("income_tier"))


def contribution(segment, keep="TRUE"):
    return f"""SELECT {segment} AS segment, count(*) AS count, {RATE},
 {pct('sum(default_risk)', '(SELECT sum(default_risk) FROM b)')} AS contribution_pct FROM b WHERE {keep} GROUP BY 1"""


silver("segment_contribution_enquiry", contribution(
    "CASE WHEN enq_L6m BETWEEN 0 AND 3 THEN enq_L6m::VARCHAR WHEN enq_L6m IN (4, 5) THEN '4-5' ELSE '6+' END"))
silver("segment_contribution_age", contribution(
    """CASE WHEN AGE < 18 OR AGE > 55 OR AGE IS NULL THEN '55+' WHEN AGE > 45 THEN '46-55' WHEN AGE > 35 THEN '36-45'
 WHEN AGE > 25 THEN '26-35' ELSE '18-25' END"""))
silver("segment_contribution_income", contribution(
    INCOME_CASE.format("<10k", "10-20k", "20-35k", "35-60k", "60k+"), "NETMONTHLYINCOME IS NOT NULL"))
silver("segment_contribution_history", contribution(
    HISTORY.format("<1yr", "1-2yr", "2-4yr", "4-8yr", "8yr+"), "Age_Oldest_TL IS NOT NULL"))


def losses(segment):
    return f"""SELECT {segment} AS segment, count(*) AS count, {r('avg(predicted_pd) * 100')} AS avg_pd_pct,
 {r(f'sum({EAD}) / 1e7')} AS ead_cr, {r(f'sum({LOSS}) / 1e7')} AS expected_loss_cr,
 {r(f'100 * sum({LOSS}) / nullif(sum({EAD}), 0)')} AS el_rate_pct FROM scored WHERE {segment} IS NOT NULL GROUP BY 1"""


scored("expected_loss_by_segment", losses("cibil_band"))
scored("expected_loss_by_age", losses(AGE_CUT))
silver("riskiest_segments", f"""SELECT *, row_number() OVER (ORDER BY default_rate_pct DESC, dimension, segment)::INTEGER AS rank
 FROM (SELECT 'Age Group' AS dimension, segment, count, default_rate_pct, risk_contribution_pct FROM ({rates(AGE_CUT)})
 UNION ALL SELECT 'Income Band', segment, count, default_rate_pct, risk_contribution_pct FROM ({rates(INCOME_CUT)}))
 QUALIFY rank <= 5""")
silver("income_chart", f"""SELECT {INCOME_CASE.format("1.<10k", "2.10-20k", "3.20-35k", "4.35-60k", "5.60k+")} AS band,
 {RATE}, count(*) AS count FROM b WHERE NETMONTHLYINCOME IS NOT NULL GROUP BY 1""")
FUNNEL = """(SELECT count(*) AS n, count(*) FILTER (num_times_delinquent > 0) AS e30,
 count(*) FILTER (num_times_60p_dpd > 0) AS e60, sum(default_risk) AS d FROM b)"""
silver("funnel_transitions", f"""SELECT 'Portfolio → 30 DPD' AS transition, {r('e30 / nullif(n, 0)')} AS rate FROM {FUNNEL}
 UNION ALL SELECT '30 DPD → 60 DPD', {r('e60 / greatest(e30, 1)')} FROM {FUNNEL}
 UNION ALL SELECT '60 DPD → Default', {r('d / greatest(e60, 1)')} FROM {FUNNEL}""")
scored("pd_histogram", f"""SELECT default_risk, bin, count(*) AS count, {r('bin / 40.0::DOUBLE')} AS bin_start,
 {r('count(*) / any_value(n)')} AS probability FROM (
 SELECT default_risk, least(floor(predicted_pd * 40), 39)::INTEGER AS bin,
  count(*) OVER (PARTITION BY default_risk)::DOUBLE AS n FROM scored) GROUP BY default_risk, bin""")
WATCH = f"""SELECT borrower_id, enq_L6m AS enquiries_6m, num_times_delinquent AS delinquencies,
 num_times_60p_dpd AS delinquencies_60dpd, {r('missed_payment_ratio')} AS missed_payment_ratio, {r('s')} AS score,
 CASE WHEN enq_L6m < 4 AND num_times_60p_dpd < 1 THEN 'MEDIUM'
   WHEN enq_L6m >= 4 AND Age_Oldest_TL < 24 THEN 'EXTREME' ELSE 'HIGH' END AS priority
 FROM (SELECT *, {score(0.35, 0.25, 0.25, 0.15)} AS s FROM b)
 WHERE default_risk = 0 AND (enq_L6m >= 3 OR num_times_delinquent >= 2 OR missed_payment_ratio >= 0.25::DOUBLE)
 ORDER BY s DESC, borrower_id LIMIT 30"""
silver("watchlist", WATCH)
silver("watchlist_priorities", f"SELECT priority, count(*) AS count FROM ({WATCH}) GROUP BY priority")
raw("distinct_education", "SELECT DISTINCT trim(EDUCATION) AS label FROM graded")


def cut(column, edges, labels):
    """Right-closed bands with an open top; everything else reads Unknown."""
    arms = " ".join(f"WHEN {column} <= {e} THEN '{name}'" for e, name in zip(edges, labels))
    return f"CASE WHEN {column} IS NULL THEN 'Unknown' {arms} ELSE '{labels[-1]}' END"


PD_CUT = cut("predicted_pd", (0.25, 0.5), ("Low Risk", "Medium Risk", "High Risk"))
BANDS = {
    "pd_band": PD_CUT,
    "age_band": f"CASE WHEN AGE <= 0 THEN 'Unknown' ELSE {cut('AGE', (25, 35, 45, 55), ('<=25', '26-35', '36-45', '46-55', '55+'))} END",
    "income_band": cut("NETMONTHLYINCOME", (25000, 50000, 100000, 200000), ("<=25k", "25k-50k", "50k-1L", "1L-2L", "2L+")),
    "enquiry_band": cut("tot_enq", (1, 3, 6), ("0-1", "2-3", "4-6", "7+")),
    "delinquency_band": cut("num_times_delinquent", (0, 2, 5), ("0", "1-2", "3-5", "6+")),
}
HISTORY_BAND = cut("Age_Oldest_TL", (12, 24, 48, 96), ("<1yr", "1-2yr", "2-4yr", "4-8yr", "8yr+"))
scored("scored_export", f"""SELECT PROSPECTID, {r('predicted_pd')} AS predicted_pd, {', '.join(f'{e} AS {n}' for n, e in BANDS.items())},
 {HISTORY_BAND} AS credit_history_band, (predicted_pd < 0.5)::INTEGER AS approved_flag,
 (predicted_pd >= 0.5)::INTEGER AS rejected_flag, {r(EAD)} AS ead_proxy, 0.45::DOUBLE AS lgd_assumption,
 {r(LOSS)} AS expected_loss, (predicted_pd >= 0.5)::INTEGER AS high_risk_flag,
 (predicted_pd >= 0.65)::INTEGER AS watchlist_flag, {r(f'predicted_pd * ({LOSS})')} AS priority_score,
 default_risk AS default_actual_label, dense_rank() OVER (ORDER BY predicted_pd DESC) AS risk_rank,
 dense_rank() OVER (ORDER BY {LOSS} DESC) AS loss_rank, tot_enq::DOUBLE AS enquiry_value,
 num_times_delinquent::DOUBLE AS delinquency_value FROM scored""")
scored("portfolio_ranks", f"""SELECT PROSPECTID, dense_rank() OVER (ORDER BY predicted_pd DESC) AS risk_rank,
 dense_rank() OVER (ORDER BY {LOSS} DESC) AS loss_rank FROM scored""")
scored("export_bands", " UNION ALL ".join(
    f"""SELECT '{n}' AS band_column, count(*) FILTER (v = 'Unknown') AS blank_rows,
 string_agg(DISTINCT v, '|' ORDER BY v) AS labels FROM (SELECT {e} AS v FROM scored)""" for n, e in BANDS.items()))
scored("export_summary", f"""SELECT count(*) AS total_rows, {r('avg((predicted_pd < 0.5)::INTEGER)')} AS approval_rate,
 {r('avg(predicted_pd)')} AS avg_pd, {r('avg((predicted_pd >= 0.5)::INTEGER)')} AS high_risk_share,
 count(*) FILTER (predicted_pd >= 0.65) AS watchlist_count, round(sum({LOSS}), 2) AS total_expected_loss FROM scored""")

# ---- scoring and policy -------------------------------------------------------------------------------------
CELLS = """count(*) FILTER (predicted_pd >= t AND default_risk = 1) AS tp,
 count(*) FILTER (predicted_pd >= t AND default_risk = 0) AS fp,
 count(*) FILTER (predicted_pd < t AND default_risk = 1) AS fn,
 count(*) FILTER (predicted_pd < t AND default_risk = 0) AS tn"""
P, R_ = "coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE", "coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE"
F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
scored("confusion_matrix", f"""SELECT tp, fp, fn, tn, {r(P)} AS precision, {r(R_)} AS recall, {r(F1)} AS f1,
 {r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM (SELECT {CELLS} FROM scored, (SELECT 0.5 AS t))""")


def grid(values):
    return "(SELECT unnest([" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]) AS t)"


def at_cutoffs(values):
    return f"(SELECT t, {CELLS} FROM scored CROSS JOIN {grid(values)} GROUP BY t)"


APPROVAL, FALSE_ALARM = "100 * (fn + tn) / (tp + fp + fn + tn)", "100 * coalesce(fp / nullif(tp + fp, 0), 0)"
POLICY_GRID = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
scored("threshold_table", f"""SELECT t AS threshold, {r(APPROVAL)} AS approval_rate_pct,
 {r(f'100 * {R_}')} AS defaults_caught_pct, {r(FALSE_ALARM)} AS false_alarm_rate_pct,
 {r(f'100 * {P}')} AS precision_pct, {r(F1)} AS f1_score, fn AS defaults_missed, fp AS safe_borrowers_rejected
 FROM {at_cutoffs(POLICY_GRID)}""")
scored("threshold_display", f"""SELECT printf('%.2f', t) AS threshold, printf('%.1f%%', {APPROVAL}) AS approval,
 printf('%.1f%%', 100 * {R_}) AS recall, printf('%.1f%%', 100 * {P}) AS precision,
 printf('%.1f%%', {FALSE_ALARM}) AS false_alarm, printf('%.3f', {F1}) AS f1,
 CASE WHEN t = 0.5 THEN '◀' ELSE '' END AS current FROM {at_cutoffs(POLICY_GRID[1:])}""")
# the grid of 81 cut-offs runs in steps of (0.1 + 0.01) - 0.1, as a float range does
SWEEP = [0.1 + i * ((0.1 + 0.01) - 0.1) for i in range(81)]
SWEPT = f"SELECT round(t, 2) AS threshold, {P} AS p, {R_} AS rc, {F1} AS f FROM {at_cutoffs(SWEEP)}"
scored("threshold_sweep", f"""SELECT threshold, {r('p')} AS precision, {r('rc')} AS recall, {r('f')} AS f1 FROM ({SWEPT})""")
PICK = f"threshold, {r('p')} AS precision, {r('rc')} AS recall, {r('f')} AS f1"
scored("best_threshold", f""", s AS ({SWEPT})
 SELECT * FROM (SELECT 'best_f1' AS rule, {PICK} FROM s ORDER BY f DESC, threshold LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'best_precision' AS rule, {PICK} FROM s
 ORDER BY rc >= 0.75 DESC, CASE WHEN rc >= 0.75 THEN p ELSE f END DESC, threshold LIMIT 1)""")


def rank_sum(column):
    """AUC from average ranks instead of cumulated counts."""
    return f"""(sum(rk) FILTER (default_risk = 1) - np * (np + 1) / 2.0::DOUBLE) / nullif(np::DOUBLE * nn, 0)
 FROM (SELECT default_risk, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE AS rk,
  count(*) FILTER (default_risk = 1) OVER () AS np, count(*) FILTER (default_risk = 0) OVER () AS nn FROM scored)
 GROUP BY np, nn"""


def auc_select(column, prefix=""):
    expression, rest = rank_sum(column).split("\n FROM", 1)
    return f"SELECT {prefix} np AS positives, nn AS negatives, ({expression}) AS auc FROM{rest}"


scored("auc_exact", f"SELECT positives, negatives, {r('auc')} AS auc FROM ({auc_select('predicted_pd')})")
LONE = ("num_times_delinquent", "num_times_60p_dpd", "delinquency_score", "missed_payment_ratio", "Total_TL",
        "active_loan_ratio", "loan_type_diversity", "Age_Oldest_TL", "AGE", "NETMONTHLYINCOME", "enq_L6m",
        "enq_L12m", "tot_enq", "Gold_TL", "Home_TL", "Credit_Score")
EVERY_AUC = " UNION ALL ".join(auc_select(c, f"'{c}' AS feature,") for c in LONE)
scored("single_feature_auc", f"""SELECT feature, positives, negatives, {r('greatest(auc, 1 - auc)')} AS auc,
 greatest(auc, 1 - auc) > 0.99 AS leakage_suspected FROM ({EVERY_AUC})""")
scored("leakage_gate", f"""SELECT feature, {r('greatest(auc, 1 - auc)')} AS auc FROM ({EVERY_AUC})
 WHERE greatest(auc, 1 - auc) > 0.99""")
CURVE = """, steps AS (SELECT predicted_pd AS t, sum(default_risk) AS pos, count(*) - sum(default_risk) AS neg
 FROM scored GROUP BY predicted_pd),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2,
 row_number() OVER w AS i FROM steps WINDOW w AS (ORDER BY t DESC)),
tot AS (SELECT sum(pos) AS np, sum(neg) AS nn FROM steps)"""
ROC = f"{r('t')} AS threshold, {r('fp / nullif(nn, 0)')} AS fpr, {r('tp / nullif(np, 0)')} AS tpr FROM curve, tot"
ORIGIN = "UNION ALL SELECT NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"
scored("roc_points_full", f"{CURVE} SELECT {ROC} {ORIGIN}")
scored("roc_points", f"""{CURVE} SELECT {ROC} WHERE i = 1 OR pos2 IS NULL OR NOT (pos2 = pos AND neg2 = neg) {ORIGIN}""")
scored("pr_points", f"""{CURVE} SELECT {r('t')} AS threshold, {r('tp / (tp + fp)')} AS precision,
 {r('tp / nullif(np, 0)')} AS recall FROM curve, tot UNION ALL SELECT NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE""")
scored("average_precision", f"""{CURVE} SELECT max(np)::BIGINT AS positives,
 {r('sum(pos * tp / (tp + fp)) / max(np)')} AS average_precision FROM curve, tot""")
CONSERVATIVE = """(enq_L6m <= 3 AND Age_Oldest_TL >= 12 AND num_times_delinquent <= 2 AND num_times_60p_dpd <= 0
 AND NETMONTHLYINCOME >= 10000 AND predicted_pd <= 0.45::DOUBLE AND active_loan_ratio <= 1)"""
RECOMMENDED = """(enq_L6m <= 4 AND Age_Oldest_TL >= 24 AND num_times_delinquent <= 5 AND num_times_60p_dpd <= 999
 AND NETMONTHLYINCOME >= 0 AND predicted_pd <= 0.5::DOUBLE AND active_loan_ratio <= 1)"""
OPEN = """(enq_L6m <= 999 AND Age_Oldest_TL >= 0 AND num_times_delinquent <= 999 AND num_times_60p_dpd <= 999
 AND NETMONTHLYINCOME >= 0 AND predicted_pd <= {0}::DOUBLE AND active_loan_ratio <= 1)"""
POLICIES = (("Current Policy (No Restrictions)", OPEN.format("1.0")), ("Conservative Policy", CONSERVATIVE),
            ("Model B Recommended (3 Policies)", RECOMMENDED), ("Growth Mode (Relaxed)", OPEN.format("0.65")))


def outcome(name, rule, baseline):
    return f"""SELECT '{name}' AS policy_name, count(*) AS n, count(*) FILTER (ok) AS a,
 count(*) FILTER (ok AND default_risk = 1) AS bad_in, count(*) FILTER (NOT ok AND default_risk = 1) AS prevented,
 count(*) FILTER (NOT ok AND default_risk = 0) AS safe_out, coalesce(sum({LOSS}) FILTER (ok), 0) AS el,
 count(*) FILTER (base) AS ba, count(*) FILTER (NOT base AND default_risk = 1) AS bp,
 coalesce(sum({LOSS}) FILTER (base), 0) AS bel FROM (SELECT *, {rule} AS ok, {baseline} AS base FROM scored)"""


SIMULATED = f"""SELECT policy_name, n AS n_total, a AS n_approved, {pct('a', 'n')} AS approval_rate_pct,
 n - a AS n_rejected, {pct('n - a', 'n')} AS rejection_rate_pct, bad_in AS defaults_in_approved,
 {r('100 * bad_in / greatest(a, 1)')} AS default_rate_in_approved_pct, prevented AS defaults_prevented,
 safe_out AS safe_borrowers_rejected, prevented - (n - ba) AS defaults_prevented_vs_baseline,
 prevented - bp AS defaults_prevented_delta, ba - a AS approvals_lost_vs_baseline, {r('el / 1e7')} AS expected_loss_cr,
 {r('bel / 1e7')} AS baseline_el_cr, {r('(bel - el) / 1e7')} AS el_reduction_cr,
 {r('100 * (bel - el) / greatest(bel, 1)')} AS el_reduction_pct, {r('prevented / (safe_out + 1)')} AS raae FROM ({{0}})"""
scored("policy_approvals", f"SELECT PROSPECTID, {CONSERVATIVE} AS approved FROM scored")
scored("policy_simulation", SIMULATED.format(" UNION ALL ".join(outcome(n, p, "TRUE") for n, p in POLICIES)))
scored("policy_vs_baseline", SIMULATED.format(outcome("Conservative Policy", CONSERVATIVE, RECOMMENDED)))
scored("policy_comparison", f"""SELECT policy_name AS policy, {pct('a', 'n')} AS approval_rate_pct,
 {r('100 * bad_in / greatest(a, 1)')} AS default_rate_in_approved_pct, prevented AS defaults_prevented,
 safe_out AS safe_rejected, {r('el / 1e7')} AS expected_loss_cr, {r('(bel - el) / 1e7')} AS el_reduction_cr
 FROM ({" UNION ALL ".join(outcome(n, p, POLICIES[0][1]) for n, p in POLICIES)})""")
scored("policy_before_after", """, s AS (SELECT count(*) AS n, sum(default_risk)::BIGINT AS bad, count(*) FILTER (ok) AS a,
 count(*) FILTER (NOT ok AND default_risk = 1) AS prevented, count(*) FILTER (NOT ok AND default_risk = 0) AS safe_out
 FROM (SELECT *, enq_L6m <= 4 AND NETMONTHLYINCOME >= 10000 AND predicted_pd <= 0.5 AS ok FROM scored))
 SELECT 'All Borrowers' AS category, n AS baseline, n AS with_policy FROM s UNION ALL SELECT 'Approved', n, a FROM s
 UNION ALL SELECT 'Rejected', 0, n - a FROM s UNION ALL SELECT 'Defaults Caught', bad, prevented FROM s
 UNION ALL SELECT 'Safe Rejected', 0, safe_out FROM s""")

# ---- statistics ------------------------------------------------------------------------------------------------
STEPS = """, g AS (SELECT (cibil_score // 20 * 20)::INTEGER AS band_start, count(*) AS borrowers,
 sum(default_risk)::BIGINT AS risky, avg(default_risk) * 100 AS rate, avg(monthly_income_inr) AS income,
 avg(total_loans) AS loans FROM fact WHERE cibil_score BETWEEN 300 AND 799 GROUP BY 1),
 c AS (SELECT *, rate - lag(rate) OVER (ORDER BY band_start) AS change,
 band_start || '-' || (band_start + 19) AS score_band FROM g)"""
fact("score_band_table", f"""{STEPS} SELECT band_start, borrowers, risky, {r('rate')} AS default_rate_pct,
 {r('income')} AS avg_income, {r('loans')} AS avg_loans, score_band, {r('change')} AS rate_change FROM c""")
fact("steepest_band", f"""{STEPS} SELECT score_band, {r('change')} AS rate_change FROM c WHERE change IS NOT NULL
 ORDER BY change, band_start LIMIT 1""")


def gini(column, by=""):
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} count(*) AS n_borrowers, {r('''2 * sum(i * v) / nullif(count(*) * sum(v), 0)
 - (count(*) + 1.0::DOUBLE) / count(*)''')} AS gini FROM (SELECT {by + ',' if by else ''} {column}::DOUBLE AS v,
 row_number() OVER ({part} ORDER BY {column}) AS i FROM fact) {'GROUP BY ' + by if by else ''}"""


fact("gini_overall", gini("cibil_score"))
fact("gini_income", gini("monthly_income_inr"))
fact("gini_by_tier", f"""SELECT income_tier, n_borrowers, gini AS gini_score, avg_cibil, default_rate_pct
 FROM ({gini('cibil_score', 'income_tier')}) JOIN (SELECT income_tier, {r('avg(cibil_score)')} AS avg_cibil, {RATE}
 FROM fact GROUP BY income_tier) USING (income_tier) WHERE n_borrowers > 10""")
fact("risky_vs_safe", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {r('x')} AS risky_mean, {r('y')} AS safe_mean, {r('x - y')} AS difference,
 {r('100 * (x - y) / (y + 1e-6)')} AS pct_difference FROM (SELECT avg({c}) FILTER (default_risk = 1) AS x,
 avg({c}) FILTER (default_risk = 0) AS y FROM fact)"""
    for c in ("cibil_score", "num_times_delinquent", "num_times_60p_dpd", "total_loans", "monthly_income_inr",
              "credit_history_months", "recent_enquiries_6m")))
fact("gold_vs_non_gold", " UNION ALL ".join(
    f"""SELECT '{name}' AS metric, {r('x')} AS gold_borrowers, {r('y')} AS non_gold, {r('x - y')} AS difference
 FROM (SELECT avg({c}) FILTER (has_gold_loan) AS x, avg({c}) FILTER (NOT has_gold_loan) AS y FROM fact)"""
    for name, c in (("Default rate", "default_risk"), ("Avg CIBIL score", "cibil_score"),
                    ("Avg monthly income", "monthly_income_inr"), ("Avg total loans", "total_loans"),
                    ("Avg delinquencies", "num_times_delinquent"), ("Avg credit history (m)", "credit_history_months"))))
fact("ttest_gold", f"""SELECT n1 AS n_gold, n2 AS n_other, {r('k1 / n1')} AS mean_gold, {r('k2 / n2')} AS mean_other,
 {r('''(k1 / n1 - k2 / n2) / sqrt((k1 * (1 - k1 / n1) + k2 * (1 - k2 / n2)) / (n1 + n2 - 2)
   * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))''')} AS t_statistic, n1 + n2 - 2 AS degrees_of_freedom
 FROM (SELECT count(*) FILTER (has_gold_loan) AS n1, count(*) FILTER (NOT has_gold_loan) AS n2,
 sum(default_risk) FILTER (has_gold_loan)::DOUBLE AS k1, sum(default_risk) FILTER (NOT has_gold_loan)::DOUBLE AS k2
 FROM fact)""")
NUMERIC = ("cibil_score", "monthly_income_inr", "age", "delinquency_score", "missed_payment_ratio",
           "active_loan_ratio", "score_per_income_lakh", "loan_type_diversity", "credit_history_months",
           "total_loans", "num_times_delinquent", "num_times_60p_dpd", "recent_enquiries_6m")
fact("early_warning_signals", f""", c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}::DOUBLE, default_risk::DOUBLE) AS rr, count({c}) AS n FROM fact" for c in NUMERIC)}),
 t AS (SELECT *, rr * sqrt((n - 2) / nullif(1 - rr * rr, 0)) AS t FROM c WHERE n >= 100 AND NOT isnan(rr))
 SELECT feature, {r('abs(rr)')} AS correlation,
 CASE WHEN rr > 0 THEN 'higher = more risky' ELSE 'higher = less risky' END AS direction, {r('t')} AS t_statistic,
 n AS n_rows, row_number() OVER (ORDER BY abs(rr) DESC, feature)::INTEGER AS rank FROM t
 WHERE t IS NULL OR abs(t) > 1.959963984540054 + 2.372271285 / (n - 2) + 2.822502236 / (n - 2) ^ 2
 QUALIFY rank <= 20""")

# ---- explanations -------------------------------------------------------------------------------------------------
LEVEL = """CASE WHEN predicted_pd >= 0.6::DOUBLE THEN 'HIGH RISK' WHEN predicted_pd >= 0.35::DOUBLE THEN 'MEDIUM RISK'
 ELSE 'LOW RISK' END"""
ADVICE = f"""CASE {LEVEL} WHEN 'HIGH RISK' THEN 'Decline or escalate to senior credit committee. Offer to reapply after 6 months if enquiry count reduces.'
 WHEN 'MEDIUM RISK' THEN 'Proceed with additional documentation. Request 6-month bank statement and proof of income stability.'
 ELSE 'Approve under standard terms. No additional documentation required.' END"""
PD_PCT = "round_even(predicted_pd * 100, 1)"
RUPEES = "'₹' || format('{:,}', round_even(NETMONTHLYINCOME, 0)::BIGINT)"
RISKS = """[CASE WHEN enq_L6m >= 4 THEN 'Applied to ' || enq_L6m || ' lenders in the last 6 months — indicates financial stress' END,
 CASE WHEN num_times_delinquent >= 2 THEN 'Missed ' || num_times_delinquent || ' payment(s) historically — pattern of non-repayment' END,
 CASE WHEN num_times_60p_dpd >= 1 THEN 'Has ' || num_times_60p_dpd || ' serious 60+ day delinquency event(s) on record' END]"""
SAFES = f"""[CASE WHEN Age_Oldest_TL >= 48 THEN Age_Oldest_TL || '-month credit history — strong repayment track record' END,
 CASE WHEN NETMONTHLYINCOME >= 25000 THEN 'Monthly income of ' || {RUPEES} || ' — good repayment capacity' END]"""


def joined(items, separator="; "):
    return f"coalesce(array_to_string(list_filter({items}, lambda x: x IS NOT NULL), '{separator}'), '')"


FIRST = f"list_filter({RISKS}, lambda x: x IS NOT NULL)[1]"
scored("reason_codes", f"""SELECT borrower_id, {r(PD_PCT)} AS predicted_pd_pct, {LEVEL} AS risk_level,
 {joined(RISKS)} AS risk_reasons, {joined(SAFES)} AS protective_factors, {ADVICE} AS recommendation,
 'Predicted default probability: ' || printf('%.1f', {PD_PCT}) || '%. Primary concern: '
 || coalesce({FIRST}, 'No significant risk signals detected.') AS summary FROM scored""")
scored("batch_explain", f"""SELECT borrower_id, {r(PD_PCT)} AS predicted_pd_pct, {LEVEL} AS risk_level,
 coalesce({FIRST}, '—') AS primary_reason, left({ADVICE}, 60) || '...' AS recommendation FROM scored""")
MARKED = f"""[CASE WHEN enq_L6m >= 4 THEN '▲ RISK: Applied to ' || enq_L6m || ' lenders in 6 months — financial stress signal' END,
 CASE WHEN num_times_delinquent >= 2 THEN '▲ RISK: ' || num_times_delinquent || ' missed payments on record — non-repayment pattern' END,
 CASE WHEN num_times_60p_dpd >= 1 THEN '▲ RISK: ' || num_times_60p_dpd || ' serious 60+ DPD event(s) — recovery rate low' END,
 CASE WHEN missed_payment_ratio > 0.2::DOUBLE THEN '~ CAUTION: ' || round_even(missed_payment_ratio * 100, 0)::BIGINT || '% of payments missed — above threshold' END,
 CASE WHEN Age_Oldest_TL >= 36 THEN '▼ SAFE: ' || Age_Oldest_TL || '-month credit history — positive stability signal' END,
 CASE WHEN NETMONTHLYINCOME >= 25000 THEN '▼ SAFE: ' || {RUPEES} || '/month income — adequate repayment capacity' END]"""
KEPT = f"list_filter({MARKED}, lambda x: x IS NOT NULL)[1:5]"
scored("application_reasons", f"""SELECT borrower_id, {r(PD_PCT)} AS predicted_pd_pct, {LEVEL} AS risk_level,
 coalesce(array_to_string({KEPT}, '; '), '') AS reasons, len({KEPT})::INTEGER AS reason_count,
 CASE {LEVEL} WHEN 'HIGH RISK' THEN 'Decline — escalate to credit committee.'
  WHEN 'MEDIUM RISK' THEN 'Proceed with additional documentation.' ELSE 'Approve under standard terms.' END AS recommendation
 FROM scored""")
CARD = {"enq_L6m": (0.30, 2.0), "num_times_delinquent": (0.25, 1.0), "num_times_60p_dpd": (0.40, 0.5),
        "missed_payment_ratio": (0.50, 0.25), "active_loan_ratio": (0.20, 0.5),
        "loan_type_diversity": (-0.15, 2.0), "Total_TL": (-0.10, 5.0), "Gold_TL": (0.10, 1.0)}
SAID = {"enq_L6m": "'Applied to ' || enq_L6m || ' lenders in the last 6 months — indicates financial stress'",
        "num_times_delinquent": "'Missed ' || num_times_delinquent || ' payment(s) historically — pattern of non-repayment'",
        "num_times_60p_dpd": "'Has ' || num_times_60p_dpd || ' serious 60+ day delinquency event(s) on record'",
        "missed_payment_ratio": "'Missed ' || round_even(missed_payment_ratio * 100, 0)::BIGINT || '% of payments — high missed payment frequency'",
        "active_loan_ratio": "round_even(active_loan_ratio * 100, 0)::BIGINT || '% of loans are currently active — heavily overextended'",
        "loan_type_diversity": "'Loan portfolio diversity: ' || loan_type_diversity || ' (increases risk)'",
        "Total_TL": "'Total loan accounts: ' || Total_TL || ' (increases risk)'",
        "Gold_TL": "'Has ' || Gold_TL || ' gold loan(s) — may indicate collateral-backed stress borrowing'"}
silver("card_attributions", "SELECT PROSPECTID, " + ", ".join(
    f"{r(f'{beta} * ({c} - {m})')} AS phi_{c}" for c, (beta, m) in CARD.items()) + " FROM silver")
silver("card_importance", f"""SELECT *, row_number() OVER (ORDER BY mean_abs_attribution DESC, feature)::INTEGER AS rank
 FROM ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg(abs({beta} * ({c} - {m})))')} AS mean_abs_attribution FROM silver"
    for c, (beta, m) in CARD.items())})""")
LONG = " UNION ALL ".join(
    f"SELECT borrower_id, {i} AS place, '{c}' AS feature, ({c} - {m}::DOUBLE) * {beta}::DOUBLE AS phi, {SAID[c]} AS said FROM scored"
    for i, (c, (beta, m)) in enumerate(CARD.items()))
scored("attribution_reasons", f""", long AS ({LONG}),
 top AS (SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY abs(phi) DESC, place) AS rk FROM long QUALIFY rk <= 4),
 side AS (SELECT *, phi > 0 AS up, row_number() OVER (PARTITION BY borrower_id, phi > 0 ORDER BY rk) AS k FROM top
   WHERE abs(phi) > 0.05::DOUBLE QUALIFY k <= 2)
 SELECT scored.borrower_id, coalesce(string_agg(feature, ',' ORDER BY rk) FILTER (up), '') AS risk_features,
 coalesce(string_agg(feature, ',' ORDER BY rk) FILTER (NOT up), '') AS safe_features,
 coalesce(string_agg(said, '; ' ORDER BY rk) FILTER (up), '') AS risk_reasons
 FROM scored LEFT JOIN side USING (borrower_id) GROUP BY scored.borrower_id""")

# ---- p-values ---------------------------------------------------------------------------------------------------------
# I_x(a, 1/2) with 1 - x = r^2, by the power series of the other side, whose terms are all positive
TAIL = """1 - exp(0.5::DOUBLE * ln(rr * rr) + (n - 2) / 2.0::DOUBLE * ln(1 - rr * rr) - lgamma(0.5) - lgamma((n - 2) / 2.0::DOUBLE)
 + lgamma((n - 1) / 2.0::DOUBLE)) / 0.5::DOUBLE * (SELECT sum(exp(lgamma((n - 1) / 2.0::DOUBLE + k) - lgamma((n - 1) / 2.0::DOUBLE)
 - lgamma(1.5 + k) + lgamma(1.5) + k * ln(rr * rr))) FROM range(0, 6000) s(k))"""
TESTED = f"""SELECT feature, {r(f"greatest(0, {TAIL})")} AS p_value, {r("rr * rr / (1 - rr * rr) * (n - 2)")} AS f_value,
 ({TAIL}) < 0.05 AS significant FROM c"""
RELATED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}::DOUBLE, default_risk::DOUBLE) AS rr, count({c}) AS n FROM fact" for c in NUMERIC)
fact("signal_p_values", f", c AS ({RELATED}) {TESTED}")
fact("ttest_gold_p_value", f""", c AS (SELECT 'default_risk' AS feature,
 corr(default_risk::DOUBLE, has_gold_loan::INTEGER::DOUBLE) AS rr, count(*) AS n FROM fact) {TESTED}""")
ORACLE["signals_with_p_values"] = (
    ORACLE["early_warning_signals"].replace(" SELECT feature, ", ", listed AS (SELECT feature, ", 1)
    + f"), tested AS ({TESTED}) SELECT listed.*, p_value, significant FROM listed JOIN tested USING (feature)")

# ---- models: what has a counterpart in SQL --------------------------------------------------------------------------
PACES = {"enq_per_credit_year": "enq_L6m / (Age_Oldest_TL / 12.0::DOUBLE + 1)",
         "delinquency_rate": "num_times_delinquent / (Total_TL + 1.0::DOUBLE)",
         "enq_acceleration": "CASE WHEN 2 * enq_L6m > enq_L12m THEN enq_L6m - enq_L12m / 2.0::DOUBLE ELSE 0 END",
         "severe_delinquency_ratio": "num_times_60p_dpd / (num_times_delinquent + 1.0::DOUBLE)"}


def first_rows(table, salt, shares):
    """Number of the part a row is in, when each class is cut after exact shares of its rows in the order of its draws."""
    place = f"row_number() OVER (PARTITION BY default_risk ORDER BY substr(md5('{salt}:' || PROSPECTID), 1, 15), PROSPECTID)"
    limits = " + ".join(f"({place} > floor(count(*) OVER (PARTITION BY default_risk) * {s}::DOUBLE + 0.5::DOUBLE))::INTEGER"
                        for s in shares)
    return f"SELECT *, {limits} AS part FROM {table}"


SPLIT = f", split AS ({first_rows('silver', 42, [0.2])}), train AS (SELECT * EXCLUDE (part) FROM split WHERE part = 1)"
silver("train_test_sizes", f"""{SPLIT} SELECT CASE part WHEN 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n,
 {r('avg(default_risk::DOUBLE)')} AS default_rate FROM split GROUP BY ALL""")
silver("fold_sizes", f"""{SPLIT}, folds AS ({first_rows('train', 43, [i / 5 for i in range(1, 5)])})
 SELECT part AS fold, default_risk::DOUBLE AS default_risk, count(*) AS n, sum(PROSPECTID)::BIGINT AS key_sum FROM folds GROUP BY ALL""")
# every value of a feature at a rank of i / 64 is a limit; a cut sends values up to the limit to the left
NAMED = {c: c for c in (*FEATURES, *PACES)} | PACES
silver("first_splits", f"""{SPLIT},
 long AS ({" UNION ALL ".join(f"SELECT '{name}' AS feature, ({sql})::DOUBLE AS v, default_risk AS y FROM train" for name, sql in NAMED.items())}),
 placed AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS nth, count(*) OVER (PARTITION BY feature) AS n FROM long),
 limits AS (SELECT DISTINCT feature, v AS cut FROM placed, range(1, 64) t(i) WHERE nth = ceil(i / 64.0::DOUBLE * n)),
 weights AS (SELECT DISTINCT round(m * safe_per_risky, 2) AS w FROM (SELECT count(*) FILTER (y = 0) / count(*) FILTER (y = 1)::DOUBLE AS safe_per_risky
  FROM long), (SELECT unnest([{", ".join(f"{m}::DOUBLE" for m in WEIGHT_MULTIPLES)}]) AS m)),
 counted AS (SELECT feature, cut, count(*) FILTER (v <= cut AND y = 1) AS p1, count(*) FILTER (v <= cut AND y = 0) AS n1,
  count(*) FILTER (v > cut AND y = 1) AS p2, count(*) FILTER (v > cut AND y = 0) AS n2 FROM limits JOIN long USING (feature) GROUP BY ALL),
 sums AS (SELECT *, 0.5::DOUBLE * (n1 - w * p1) AS g1, 0.25::DOUBLE * (n1 + w * p1) AS h1,
  0.5::DOUBLE * (n2 - w * p2) AS g2, 0.25::DOUBLE * (n2 + w * p2) AS h2 FROM counted, weights),
 gained AS (SELECT w, feature, cut, round(g1 * g1 / (h1 + 1) + g2 * g2 / (h2 + 1) - (g1 + g2) * (g1 + g2) / (h1 + h2 + 1), 9) AS gain
  FROM sums WHERE h1 >= 1 AND h2 >= 1)
 SELECT {r('w')} AS scale_pos_weight, feature, {r('cut')} AS cut, {r('gain')} AS gain FROM gained
 QUALIFY row_number() OVER (PARTITION BY w, feature ORDER BY gain DESC, cut) = 1""")

# ---- clusters -----------------------------------------------------------------------------------------------------------
SCALED_SQL = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)::DOUBLE AS z_{c}"
                       for c in CLUSTER_FEATURES)
ZED = f""", zed AS (SELECT borrower_id, {SCALED_SQL} FROM fact WHERE
 {" AND ".join(f"{c} IS NOT NULL" for c in CLUSTER_FEATURES)})"""
fact("standardised", f"{ZED} SELECT borrower_id, {', '.join(f'{r(f'z_{c}')} AS z_{c}' for c in CLUSTER_FEATURES)} FROM zed")
AWAY = " + ".join(f"(z_{c} - s) ^ 2" for c in CLUSTER_FEATURES)
fact("cluster_iteration", f"""{ZED}, starts AS (SELECT * FROM (VALUES (0, -1.0::DOUBLE), (1, 0.0::DOUBLE), (2, 1.0::DOUBLE)) t(centre, s)),
 nearest AS (SELECT * FROM zed, starts QUALIFY row_number() OVER (PARTITION BY borrower_id ORDER BY {AWAY}, centre) = 1)
 SELECT starts.centre, count(borrower_id) AS n, {', '.join(f'{r(f'coalesce(avg(z_{c}), any_value(starts.s))')} AS z_{c}' for c in CLUSTER_FEATURES)}
 FROM starts LEFT JOIN nearest USING (centre) GROUP BY starts.centre""")

# ---- books with gaps ------------------------------------------------------------------------------------------
GAPS = {"NETMONTHLYINCOME": "PROSPECTID % 7 = 3", "AGE": "PROSPECTID % 11 = 5", "EDUCATION": "PROSPECTID % 13 = 1",
        "MARITALSTATUS": "PROSPECTID % 17 = 2", "Gold_TL": "PROSPECTID % 19 = 4", "CC_utilization": "PROSPECTID % 5 = 2",
        "Time_With_Curr_Empr": "PROSPECTID % 23 = 6"}
HOLED = ", ".join(f"CASE WHEN {lost} THEN NULL ELSE {c} END AS {c}" for c, lost in GAPS.items())
# what a missing value means: exposures take the median income, policy rules an income of 0, an unknown utilisation is a card
MEANT = (("AS Approved_Flag FROM raw)", f"AS Approved_Flag FROM (SELECT * REPLACE ({HOLED}) FROM raw))"),
         ("(CC_utilization <> -99999)", "(CC_utilization IS DISTINCT FROM -99999)"),
         ("NETMONTHLYINCOME * 12", "coalesce(NETMONTHLYINCOME, (SELECT median(NETMONTHLYINCOME) FROM scored)) * 12"),
         ("AND NETMONTHLYINCOME >= ", "AND coalesce(NETMONTHLYINCOME, 0) >= "))
for _name in ("silver_features", "clean_categories", "quality_checks", "default_by_segment", "income_vs_default", "gold_loan_buckets",
              "early_intervention", "risk_by_age", "risk_by_education", "risky_vs_safe", "early_warning_signals", "describe_income_by_grade",
              "column_profile", "portfolio_summary", "headline_kpis", "segment_rates_age", "segment_rates_income",
              "segment_contribution_age", "segment_contribution_income", "expected_loss_by_segment", "expected_loss_by_age",
              "export_bands", "reason_codes", "policy_simulation", "policy_vs_baseline", "policy_comparison", "policy_before_after"):
    _sql = ORACLE[_name]
    for _plain, _said in MEANT:
        _sql = _sql.replace(_plain, _said)
    ORACLE[f"{_name}_gappy"] = _sql

# ---- files: what jobs and sinks stored, read back ------------------------------------------
raw("bank_csv", f"SELECT {BANK}, {USED} FROM graded")
raw("bronze_bank", f"SELECT {BANK}, {USED}, 'kaggle_internal_bank' AS _source FROM graded")
raw("bronze_bureau", f"SELECT {BUREAU}, {INCOME}, 'kaggle_cibil_external' AS _source FROM graded")
ORACLE["bronze_applications"] = ORACLE["application_summary"]
ORACLE["silver_stored"] = ORACLE["silver_features"]
ORACLE["metrics_stored"] = ORACLE["portfolio_summary"]
raw("tables_exported", """SELECT 'exported_' || t.name AS table_name, count(*) AS row_count, count(DISTINCT PROSPECTID) AS borrowers
 FROM graded CROSS JOIN (VALUES ('dim_borrower'), ('dim_credit'), ('dim_loan_portfolio'), ('fact_credit_risk')) AS t(name)
 GROUP BY t.name""")
silver("report_by_sql", """SELECT income_tier, cibil_band, count(*) AS borrowers, sum(default_risk)::BIGINT AS defaults
 FROM silver GROUP BY income_tier, cibil_band""")
