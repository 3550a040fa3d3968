"""Shared SQL for the cross-check: borrower tables from the raw tables, as CTEs.

Written separately from the Spark pipeline and shaped differently on purpose: one wide
three-way join and a single grouping instead of staged aggregates.
"""

RAW = """
clock AS (SELECT max(o_orderdate) AS d FROM orders),
li AS (
  SELECT o.o_custkey AS ck, o.o_orderstatus AS st, p.p_type AS pt,
         date_diff('day', o.o_orderdate, c.d) AS od,
         date_diff('day', l.l_shipdate, c.d) AS sd,
         (l.l_linenumber = 1 AND l.l_quantity <= 25) AS tl,
         l.l_returnflag = 'R' AS ret, l.l_discount AS disc, l.l_tax AS tax
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey CROSS JOIN clock c),
per AS (
  SELECT ck, count(*) AS n_all,
    count(*) FILTER (tl) AS tl_all, count(*) FILTER (tl AND st = 'O') AS tl_open,
    count(*) FILTER (tl AND st = 'F') AS tl_done, count(*) FILTER (tl AND od < 180) AS tl_new,
    count(*) FILTER (ret AND tax >= 0.07) AS missed,
    max(floor(od / 30.0)) FILTER (tl) AS a_max, min(floor(od / 30.0)) FILTER (tl) AS a_min,
    count(*) FILTER (tl AND pt = 'ECONOMY') AS t_gold, count(*) FILTER (tl AND pt = 'SMALL') AS t_home,
    count(*) FILTER (tl AND pt = 'MEDIUM') AS t_pl, count(*) FILTER (tl AND pt = 'LARGE') AS t_cc,
    count(*) FILTER (tl AND pt = 'STANDARD') AS t_auto, count(*) FILTER (tl AND pt = 'PROMO') AS t_cons,
    count(*) FILTER (sd BETWEEN 0 AND 179) AS q6, count(*) FILTER (sd BETWEEN 0 AND 359) AS q12,
    count(*) FILTER (ret AND disc >= 0.09) AS dl,
    count(*) FILTER (ret AND disc >= 0.09 AND tax >= 0.04) AS dl30,
    count(*) FILTER (ret AND disc >= 0.09 AND tax >= 0.07) AS dl60,
    min(sd) FILTER (NOT ret AND sd >= 0) AS pay,
    max(pt) FILTER (pt IN ('ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD')) AS p_last,
    min(pt) FILTER (pt IN ('ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD')) AS p_first
  FROM li GROUP BY ck),
counts AS (
  SELECT cu.c_custkey AS PROSPECTID,
    coalesce(tl_all, 0)::BIGINT AS Total_TL, coalesce(tl_open, 0)::BIGINT AS Tot_Active_TL,
    coalesce(tl_done, 0)::BIGINT AS Tot_Closed_TL, coalesce(tl_new, 0)::BIGINT AS Total_TL_opened_L6M,
    coalesce(missed, 0)::BIGINT AS Tot_Missed_Pmnt,
    coalesce(t_gold, 0)::BIGINT AS Gold_TL, coalesce(t_home, 0)::BIGINT AS Home_TL,
    coalesce(t_pl, 0)::BIGINT AS PL_TL, coalesce(t_cc, 0)::BIGINT AS CC_TL,
    coalesce(t_auto, 0)::BIGINT AS Auto_TL, coalesce(t_cons, 0)::BIGINT AS Consumer_TL,
    coalesce(a_max, -99999)::BIGINT AS Age_Oldest_TL, coalesce(a_min, -99999)::BIGINT AS Age_Newest_TL,
    coalesce(q6, 0)::BIGINT AS enq_L6m, coalesce(q12, 0)::BIGINT AS enq_L12m,
    coalesce(n_all, 0)::BIGINT AS tot_enq,
    coalesce(dl, 0)::BIGINT AS num_times_delinquent, coalesce(dl30, 0)::BIGINT AS num_times_30p_dpd,
    coalesce(dl60, 0)::BIGINT AS num_times_60p_dpd,
    coalesce(pay, -99999)::BIGINT AS time_since_recent_payment,
    coalesce(p_last, 'none') AS last_prod_enq2, coalesce(p_first, 'none') AS first_prod_enq2,
    CASE WHEN c_acctbal > 0 THEN c_acctbal * 8 ELSE 0.0 END::DOUBLE AS NETMONTHLYINCOME,
    (18 + (c_custkey * 7919) % 52)::INTEGER AS AGE,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE ' f ' END AS GENDER,
    CASE WHEN c_nationkey % 3 = 0 THEN ' mARried ' ELSE 'Single' END AS MARITALSTATUS,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ' ssc' WHEN 'BUILDING' THEN '12th'
      WHEN 'FURNITURE' THEN 'Graduate ' WHEN 'HOUSEHOLD' THEN 'post-graduate'
      WHEN 'MACHINERY' THEN 'Under Graduate' END AS EDUCATION,
    ((c_custkey * 31) % 240)::INTEGER AS Time_With_Curr_Empr,
    ((c_custkey * 31) % 100)::DOUBLE / 100.0::DOUBLE AS u, (c_custkey * 104729) % 61 AS jitter
  FROM customer cu LEFT JOIN per ON per.ck = cu.c_custkey),
raw AS (
  SELECT * EXCLUDE (u, jitter),
    Gold_TL + Home_TL + Auto_TL AS Secured_TL, PL_TL + CC_TL + Consumer_TL AS Unsecured_TL,
    (Gold_TL > 0)::INTEGER AS GL_Flag, (Home_TL > 0)::INTEGER AS HL_Flag,
    (PL_TL > 0)::INTEGER AS PL_Flag, (CC_TL > 0)::INTEGER AS CC_Flag,
    CASE WHEN num_times_delinquent = 0 THEN -99999
         ELSE 30 * (1 + least(num_times_60p_dpd, 2)) END::BIGINT AS max_deliq_6mts,
    CASE WHEN CC_TL = 0 THEN -99999.0 ELSE u END::DOUBLE AS CC_utilization,
    CASE WHEN PL_TL = 0 THEN -99999.0 ELSE u END::DOUBLE AS PL_utilization,
    least(900, greatest(300, 790 - 30 * num_times_delinquent - 25 * num_times_60p_dpd - 14 * enq_L6m
      + CASE WHEN Total_TL = 0 THEN 0 ELSE least(Age_Oldest_TL, 80) END + jitter - 30))::INTEGER AS Credit_Score
  FROM counts),
graded AS (
  SELECT *, CASE WHEN Credit_Score >= 780 THEN 'P1' WHEN Credit_Score >= 690 THEN 'P2'
                 WHEN Credit_Score >= 645 THEN 'P3' ELSE 'P4' END AS Approved_Flag FROM raw)
"""

SILVER = RAW + """,
tidy AS (
  SELECT * REPLACE (
    CASE WHEN CC_utilization = -99999 THEN 0.0::DOUBLE ELSE CC_utilization END AS CC_utilization,
    CASE WHEN PL_utilization = -99999 THEN 0.0::DOUBLE ELSE PL_utilization END AS PL_utilization,
    CASE WHEN Age_Oldest_TL = -99999 THEN 9999 ELSE Age_Oldest_TL END::BIGINT AS Age_Oldest_TL,
    CASE WHEN Age_Newest_TL = -99999 THEN 9999 ELSE Age_Newest_TL END::BIGINT AS Age_Newest_TL,
    CASE WHEN AGE = -99999 THEN 9999 ELSE AGE END::INTEGER AS AGE,
    CASE WHEN time_since_recent_payment = -99999 THEN 9999
         ELSE time_since_recent_payment END::BIGINT AS time_since_recent_payment,
    CASE WHEN max_deliq_6mts = -99999 THEN 0 ELSE max_deliq_6mts END::BIGINT AS max_deliq_6mts,
    upper(trim(coalesce(GENDER, 'nan'))) AS GENDER,
    upper(left(trim(coalesce(MARITALSTATUS, 'nan')), 1))
      || lower(substr(trim(coalesce(MARITALSTATUS, 'nan')), 2)) AS MARITALSTATUS,
    CASE upper(trim(coalesce(EDUCATION, 'nan'))) WHEN '12TH' THEN '12TH' WHEN 'SSC' THEN 'SSC'
      WHEN 'GRADUATE' THEN 'GRADUATE' WHEN 'POST-GRADUATE' THEN 'POST_GRADUATE'
      WHEN 'PROFESSIONAL' THEN 'PROFESSIONAL' ELSE 'OTHERS' END AS EDUCATION),
    (CC_utilization <> -99999)::INTEGER AS has_cc, (PL_utilization <> -99999)::INTEGER AS has_pl,
    CASE Approved_Flag WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 WHEN 'P4' THEN 4 END::INTEGER AS risk_grade,
    CASE WHEN Approved_Flag IN ('P3', 'P4') THEN 1 ELSE 0 END::INTEGER AS default_risk
  FROM graded),
silver AS (
  SELECT *,
    CASE WHEN Total_TL > 0 THEN Tot_Active_TL::DOUBLE / Total_TL ELSE 0.0 END::DOUBLE AS active_loan_ratio,
    CASE WHEN Total_TL > 0 THEN Tot_Missed_Pmnt::DOUBLE / Total_TL ELSE 0.0 END::DOUBLE AS missed_payment_ratio,
    Age_Oldest_TL AS credit_history_months,
    CASE WHEN NETMONTHLYINCOME > 0 THEN Credit_Score / (NETMONTHLYINCOME / 100000.0::DOUBLE)
         ELSE 0.0 END::DOUBLE AS score_per_income_lakh,
    CASE WHEN NETMONTHLYINCOME <= 0 THEN 'nan' WHEN NETMONTHLYINCOME <= 15000 THEN 'very_low'
      WHEN NETMONTHLYINCOME <= 30000 THEN 'low' WHEN NETMONTHLYINCOME <= 60000 THEN 'middle'
      WHEN NETMONTHLYINCOME <= 100000 THEN 'upper_middle' WHEN NETMONTHLYINCOME > 100000 THEN 'high'
      ELSE 'nan' END AS income_tier,
    (2 * num_times_delinquent + 3 * num_times_30p_dpd + 5 * num_times_60p_dpd)::BIGINT AS delinquency_score,
    CASE WHEN Total_TL_opened_L6M > 0 THEN 1 ELSE 0 END::INTEGER AS recently_active,
    (len(list_filter([Auto_TL, CC_TL, Consumer_TL, Gold_TL, Home_TL, PL_TL], lambda x: x > 0)))::INTEGER
      AS loan_type_diversity,
    CASE WHEN Credit_Score BETWEEN 1 AND 549 THEN 'poor' WHEN Credit_Score BETWEEN 550 AND 649 THEN 'fair'
      WHEN Credit_Score BETWEEN 650 AND 699 THEN 'good' WHEN Credit_Score BETWEEN 700 AND 749 THEN 'very_good'
      WHEN Credit_Score BETWEEN 750 AND 900 THEN 'excellent' ELSE 'nan' END AS cibil_band,
    CASE Approved_Flag WHEN 'P1' THEN 'Low Risk' WHEN 'P2' THEN 'Low Risk' WHEN 'P3' THEN 'Medium Risk'
      WHEN 'P4' THEN 'High Risk' ELSE 'Unknown' END AS grade_band
  FROM tidy),
b AS (SELECT PROSPECTID AS borrower_id, * FROM silver)
"""

SCORED = SILVER + """,
scored AS (
  SELECT *, greatest(0.02::DOUBLE, least(0.97::DOUBLE,
      least(enq_L6m::DOUBLE / 6.0::DOUBLE, 1.0::DOUBLE) * 0.30::DOUBLE
    + least(num_times_delinquent::DOUBLE / 10.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE
    + least(missed_payment_ratio, 1.0::DOUBLE) * 0.20::DOUBLE
    + active_loan_ratio * 0.15::DOUBLE
    + least(num_times_60p_dpd::DOUBLE / 3.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE
    - greatest(0.0::DOUBLE, (least(Age_Oldest_TL::DOUBLE, 300.0::DOUBLE) - 24.0::DOUBLE) / 276.0::DOUBLE) * 0.15::DOUBLE
    - greatest(0.0::DOUBLE, (NETMONTHLYINCOME - 10000.0::DOUBLE) / 490000.0::DOUBLE) * 0.10::DOUBLE
    )) AS predicted_pd
  FROM b)
"""

FACT = SILVER + """,
fact AS (
  SELECT PROSPECTID AS borrower_id, default_risk, Approved_Flag AS risk_grade, risk_grade AS risk_score,
    Credit_Score AS cibil_score, NETMONTHLYINCOME AS monthly_income_inr, AGE AS age, delinquency_score,
    missed_payment_ratio, active_loan_ratio, score_per_income_lakh, loan_type_diversity,
    credit_history_months, income_tier, cibil_band,
    CASE WHEN AGE < 25 THEN 'under_25' WHEN AGE < 35 THEN '25_to_34' WHEN AGE < 45 THEN '35_to_44'
         WHEN AGE < 55 THEN '45_to_54' ELSE '55_plus' END AS age_band,
    GENDER AS gender, EDUCATION AS education, MARITALSTATUS AS marital_status, Gold_TL > 0 AS has_gold_loan,
    Home_TL > 0 AS has_home_loan, PL_TL > 0 AS has_personal_loan, Total_TL AS total_loans,
    num_times_delinquent, num_times_60p_dpd, enq_L6m AS recent_enquiries_6m
  FROM silver)
"""


def with_tables(base: str, body: str) -> str:
    return f"WITH {base.strip()}\n{body.strip()}"


def r(expression: str) -> str:
    """A number rounded to six digits without negative zero, as the Spark side settles it."""
    return f"(round(({expression})::DOUBLE, 6) + 0.0::DOUBLE)"
