"""Fixed values that results depend on.

Everything here is data, not logic: business parameters, vocabularies, band
edges and display texts that must hold exactly for results to be comparable.
"""

from __future__ import annotations

import math

INF = math.inf

# ---- fixed values: keys and markers -------------------------------------------------
KEY = "PROSPECTID"
TARGET = "default_risk"
NOT_APPLICABLE = -99999
META_COLUMNS = ("_source", "_ingested_at")

# ---- fixed values: business parameters ----------------------------------------------
LGD = 0.45
EAD_MONTHS = 12
CRORE = 1e7
DECISION_THRESHOLD = 0.50
WATCHLIST_THRESHOLD = 0.65
TUNED_CLASS_WEIGHT = 1.43
POLICY_ACTION_RATE = 0.70
POLICY_SAVE_RATE = 0.20
LEAKAGE_AUC = 0.99

# ---- fixed values: model inputs ------------------------------------------------------
FEATURES = (
    "num_times_delinquent",
    "num_times_60p_dpd",
    "delinquency_score",
    "missed_payment_ratio",
    "Total_TL",
    "active_loan_ratio",
    "loan_type_diversity",
    "Age_Oldest_TL",
    "AGE",
    "NETMONTHLYINCOME",
    "enq_L6m",
    "enq_L12m",
    "tot_enq",
    "Gold_TL",
    "Home_TL",
)
ENGINEERED_FEATURES = (
    "enq_per_credit_year",
    "delinquency_rate",
    "enq_acceleration",
    "severe_delinquency_ratio",
)
SCORE_FEATURE = "Credit_Score"

# ---- fixed values: grade and education vocabularies ---------------------------------
GRADE_ORDINAL = {"P1": 1, "P2": 2, "P3": 3, "P4": 4}
RISKY_GRADES = ("P3", "P4")
GRADE_BAND = {"P1": "Low Risk", "P2": "Low Risk", "P3": "Medium Risk", "P4": "High Risk"}
EDUCATION_LEVELS = {
    "12TH": "12TH",
    "SSC": "SSC",
    "GRADUATE": "GRADUATE",
    "POST-GRADUATE": "POST_GRADUATE",
    "PROFESSIONAL": "PROFESSIONAL",
    "OTHERS": "OTHERS",
}
LOAN_TYPE_COUNTS = ("Auto_TL", "CC_TL", "Consumer_TL", "Gold_TL", "Home_TL", "PL_TL")
DELINQUENCY_WEIGHTS = {
    "num_times_delinquent": 2,
    "num_times_30p_dpd": 3,
    "num_times_60p_dpd": 5,
}

# ---- fixed values: column-name patterns ---------------------------------------------
UTILISATION_FLAGS = {"CC_utilization": "has_cc", "PL_utilization": "has_pl"}
ELAPSED_TIME_PATTERNS = ("time_since", "age")
ELAPSED_TIME_FILL = 9999
DELINQUENCY_LEVEL_PATTERNS = ("max_deliq", "level_of_deliq")
DELINQUENCY_SUMMARY_PATTERNS = ("delinq", "dpd", "missed")

# ---- fixed values: right-closed bands (edges, labels) --------------------------------
INCOME_TIER = ((0, 15000, 30000, 60000, 100000, INF),
               ("very_low", "low", "middle", "upper_middle", "high"))
SCORE_BAND = ((0, 549, 649, 699, 749, 900),
              ("poor", "fair", "good", "very_good", "excellent"))
EXPORT_PD_BAND = ((-INF, 0.25, 0.50, INF), ("Low Risk", "Medium Risk", "High Risk"))
EXPORT_AGE_BAND = ((0, 25, 35, 45, 55, INF), ("<=25", "26-35", "36-45", "46-55", "55+"))
EXPORT_INCOME_BAND = ((-INF, 25000, 50000, 100000, 200000, INF),
                      ("<=25k", "25k-50k", "50k-1L", "1L-2L", "2L+"))
EXPORT_ENQUIRY_BAND = ((-INF, 1, 3, 6, INF), ("0-1", "2-3", "4-6", "7+"))
EXPORT_DELINQUENCY_BAND = ((-INF, 0, 2, 5, INF), ("0", "1-2", "3-5", "6+"))
EXPORT_HISTORY_BAND = ((-INF, 12, 24, 48, 96, INF), ("<1yr", "1-2yr", "2-4yr", "4-8yr", "8yr+"))
LEADERBOARD_AGE_BAND = ((18, 25, 35, 45, 55, 75), ("18-25", "26-35", "36-45", "46-55", "55+"))
LEADERBOARD_INCOME_BAND = ((0, 10000, 20000, 35000, 60000, 500000),
                           ("<10k", "10-20k", "20-35k", "35-60k", "60k+"))

# ---- fixed values: left-closed bands -------------------------------------------------
PD_BANDS = (("Low Risk", 0.00, 0.25), ("Medium Risk", 0.25, 0.50), ("High Risk", 0.50, 1.00))
SCORE_STEP = 20
SCORE_STEP_RANGE = (300, 800)
GOLD_AGE_BANDS = (("under_25", 25), ("25_to_34", 35), ("35_to_44", 45), ("45_to_54", 55))
GOLD_AGE_LAST = "55_plus"

# ---- fixed values: labels of the report bands ----------------------------------------
ENQUIRY_LABELS = ("0 enquiries", "1 enquiry", "2 enquiries", "3 enquiries",
                  "4-5 enquiries", "6+ enquiries")
ENQUIRY_SEGMENTS = ("0", "1", "2", "3", "4-5", "6+")
HISTORY_LABELS = ("Under 1 year", "1-2 years", "2-4 years", "4-8 years", "8+ years")
HISTORY_SEGMENTS = ("<1yr", "1-2yr", "2-4yr", "4-8yr", "8yr+")
INCOME_LABELS = ("1. <10k", "2. 10-20k", "3. 20-35k", "4. 35-60k", "5. 60k+")
INCOME_CHART_LABELS = ("1.<10k", "2.10-20k", "3.20-35k", "4.35-60k", "5.60k+")
INCOME_SEGMENTS = ("<10k", "10-20k", "20-35k", "35-60k", "60k+")
AGE_SEGMENTS = ("18-25", "26-35", "36-45", "46-55", "55+")
GOLD_LOAN_LABELS = ("No gold loans", "1 gold loan", "2 gold loans", "3+ gold loans")
FUNNEL_STAGES = ("Active Portfolio", "Ever 30+ DPD", "Ever 60+ DPD", "Confirmed Default")
FUNNEL_TRANSITIONS = ("Portfolio → 30 DPD", "30 DPD → 60 DPD", "60 DPD → Default")
HIGH_RISK_RULES = ("High Enquiry (4+ in 6m)", "Thin File (<2yr history)",
                   "Severe Delinquency (60+ DPD ever)", "Extreme Risk (Rule 1 AND Rule 2)")
RISK_SEGMENTS = ("extreme_risk", "high_risk", "standard_risk")
INTERVENTION_PRIORITIES = ("EXTREME — Act immediately", "HIGH — Contact this week",
                           "MEDIUM — Monitor closely", "LOW — Standard monitoring")
WATCHLIST_PRIORITIES = ("EXTREME", "HIGH", "MEDIUM")
UNKNOWN_LABELS = ("nan", "", "None", "Unknown")

# ---- fixed values: score weights ------------------------------------------------------
INTERVENTION_WEIGHTS = {"enq_L6m": 0.30, "num_times_delinquent": 0.25,
                        "missed_payment_ratio": 0.25, "active_loan_ratio": 0.20}
WATCHLIST_WEIGHTS = {"enq_L6m": 0.35, "num_times_delinquent": 0.25,
                     "missed_payment_ratio": 0.25, "active_loan_ratio": 0.15}

# ---- fixed values: threshold grids ----------------------------------------------------
POLICY_CUTOFFS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
DISPLAY_CUTOFFS = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 0.1, 0.91, 0.01
SWEEP_MIN_RECALL = 0.75
WEIGHT_MULTIPLES = (0.3, 0.5, 0.7, 1.0, 1.5, 2.0)
WEIGHT_MIN_RECALL = 0.70

# ---- fixed values: cluster analysis ---------------------------------------------------
CLUSTER_FEATURES = ("cibil_score", "delinquency_score", "active_loan_ratio",
                    "credit_history_months", "monthly_income_inr", "total_loans")
CLUSTER_COUNTS = (3, 4, 5)
CLUSTER_NAMES = ("Safe Established", "Low Risk", "Moderate Risk", "Stressed Borrower", "High Risk")

# ---- fixed values: comparison tables --------------------------------------------------
RISKY_SAFE_COLUMNS = ("cibil_score", "num_times_delinquent", "num_times_60p_dpd", "total_loans",
                      "monthly_income_inr", "credit_history_months", "recent_enquiries_6m")
GOLD_METRICS = (("Default rate", "default_risk"), ("Avg CIBIL score", "cibil_score"),
                ("Avg monthly income", "monthly_income_inr"), ("Avg total loans", "total_loans"),
                ("Avg delinquencies", "num_times_delinquent"),
                ("Avg credit history (m)", "credit_history_months"))
SIGNAL_EXCLUDED = ("borrower_id", "default_risk", "risk_score")
SIGNAL_DIRECTIONS = ("higher = more risky", "higher = less risky")

# ---- fixed values: explanation texts --------------------------------------------------
FEATURE_LABELS = {
    "enq_L6m": "Recent credit enquiries (last 6 months)",
    "enq_L12m": "Credit enquiries in last 12 months",
    "tot_enq": "Total lifetime credit enquiries",
    "num_times_delinquent": "Missed payment count",
    "num_times_60p_dpd": "Serious delinquencies (60+ days overdue)",
    "delinquency_score": "Delinquency severity score",
    "missed_payment_ratio": "Fraction of payments missed",
    "Age_Oldest_TL": "Credit history length",
    "Total_TL": "Total loan accounts",
    "active_loan_ratio": "Active loan overextension",
    "loan_type_diversity": "Loan portfolio diversity",
    "AGE": "Borrower age",
    "NETMONTHLYINCOME": "Monthly income",
    "Gold_TL": "Gold loan accounts",
    "Home_TL": "Home loan accounts",
    "enq_per_credit_year": "Enquiries per year of credit history",
    "delinquency_rate": "Delinquency rate (misses per loan)",
    "enq_acceleration": "Acceleration of recent enquiries",
    "severe_delinquency_ratio": "Proportion of severe delinquencies",
}
RISK_LEVELS = (("HIGH RISK", 0.60), ("MEDIUM RISK", 0.35), ("LOW RISK", None))
RECOMMENDATIONS = {
    "HIGH RISK": "Decline or escalate to senior credit committee. "
                 "Offer to reapply after 6 months if enquiry count reduces.",
    "MEDIUM RISK": "Proceed with additional documentation. "
                   "Request 6-month bank statement and proof of income stability.",
    "LOW RISK": "Approve under standard terms. No additional documentation required.",
}
SHORT_RECOMMENDATIONS = {
    "HIGH RISK": "Decline — escalate to credit committee.",
    "MEDIUM RISK": "Proceed with additional documentation.",
    "LOW RISK": "Approve under standard terms.",
}
NO_RISK_SIGNAL = "No significant risk signals detected."
NO_REASON = "—"
ATTRIBUTION_CUTOFF = 0.05
RECOMMENDATION_PREVIEW = 60

# ---- fixed values: sentences; {whole} cuts the fraction, {rounded} and {percent} round it,
# ---- {rupees} adds the currency sign and thousands separators
RISK_SENTENCES = {
    "enq_L6m": "Applied to {whole} lenders in the last 6 months — indicates financial stress",
    "num_times_delinquent": "Missed {whole} payment(s) historically — pattern of non-repayment",
    "num_times_60p_dpd": "Has {whole} serious 60+ day delinquency event(s) on record",
    "missed_payment_ratio": "Missed {percent}% of payments — high missed payment frequency",
    "delinquency_score": "Delinquency severity score of {rounded} — above risk threshold",
    "active_loan_ratio": "{percent}% of loans are currently active — heavily overextended",
    "Age_Oldest_TL": "Established {whole}-month credit history — positive stability signal",
    "NETMONTHLYINCOME": "Monthly income of {rupees} — limited repayment buffer",
    "Gold_TL": "Has {whole} gold loan(s) — may indicate collateral-backed stress borrowing",
    "enq_acceleration": "Enquiry pace has increased recently — accelerating credit search",
}
# sentences that take the place of the above where the condition on the value holds
RISK_SENTENCE_EXCEPTIONS = {
    "Age_Oldest_TL": ("< 24", "Credit history of only {whole} months — insufficient track record"),
    "NETMONTHLYINCOME": ("> 20000", "Monthly income of {rupees} — adequate repayment capacity"),
}
SAFE_SENTENCES = {
    "Age_Oldest_TL": "{whole}-month credit history — strong repayment track record",
    "NETMONTHLYINCOME": "Monthly income of {rupees} — good repayment capacity",
    "loan_type_diversity": "Manages {whole} loan type(s) — diversified credit experience",
    "Total_TL": "{whole} total loan accounts — experienced borrower profile",
}
OTHER_RISK_ENDING, OTHER_SAFE_ENDING = " (increases risk)", " (reduces risk)"
# rules that need no attribution: feature, at least, weight, label, value if the column is absent
RISK_RULES = (("enq_L6m", 4, 0.9, "Recent enquiries", 0),
              ("num_times_delinquent", 2, 0.65, "Missed payments", 0),
              ("num_times_60p_dpd", 1, 0.45, "60+ DPD", 0))
SAFE_RULES = (("Age_Oldest_TL", 48, -0.46, "Credit history", 120),
              ("NETMONTHLYINCOME", 25000, -0.20, "Monthly income", 30000))
# the application scorer's list: mark, feature, condition, sentence
APPLICATION_RULES = (
    ("▲ RISK", "enq_L6m", ">= 4", "Applied to {whole} lenders in 6 months — financial stress signal"),
    ("▲ RISK", "num_times_delinquent", ">= 2", "{whole} missed payments on record — non-repayment pattern"),
    ("▲ RISK", "num_times_60p_dpd", ">= 1", "{whole} serious 60+ DPD event(s) — recovery rate low"),
    ("~ CAUTION", "missed_payment_ratio", "> 0.2", "{percent}% of payments missed — above threshold"),
    ("▼ SAFE", "Age_Oldest_TL", ">= 36", "{whole}-month credit history — positive stability signal"),
    ("▼ SAFE", "NETMONTHLYINCOME", ">= 25000", "{rupees}/month income — adequate repayment capacity"),
)
SUMMARY_SENTENCE = ("Predicted default probability: ", "%. Primary concern: ")
