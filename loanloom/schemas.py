"""Declared schemas of the raw inputs; scans never infer types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
             "string": T.StringType()}
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


BANK = _struct(
    "PROSPECTID:long Total_TL:long Tot_Active_TL:long Tot_Closed_TL:long "
    "Total_TL_opened_L6M:long Tot_Missed_Pmnt:long Gold_TL:long Home_TL:long PL_TL:long "
    "CC_TL:long Auto_TL:long Consumer_TL:long Secured_TL:long Unsecured_TL:long "
    "Age_Oldest_TL:long Age_Newest_TL:long enq_L6m:long enq_L12m:long tot_enq:long "
    "CC_utilization:double PL_utilization:double"
)

BUREAU = _struct(
    "PROSPECTID:long Approved_Flag:string Credit_Score:int AGE:int GENDER:string "
    "MARITALSTATUS:string EDUCATION:string NETMONTHLYINCOME:double "
    "num_times_delinquent:long num_times_30p_dpd:long num_times_60p_dpd:long "
    "max_deliq_6mts:long time_since_recent_payment:long last_prod_enq2:string "
    "first_prod_enq2:string Time_With_Curr_Empr:int GL_Flag:int HL_Flag:int PL_Flag:int "
    "CC_Flag:int"
)

LOAN_APPLICATIONS = _struct(
    "Disbursed:int Loan_Amount_Applied:double Loan_Tenure_Applied:double "
    "Monthly_Income:double Existing_EMI:double age:double"
)

DATA_DICTIONARY = _struct("name:string description:string")

MODEL_METRICS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in
     ("test_auc", "test_precision", "test_recall", "test_f1", "cv_auc_mean", "cv_auc_std")]
    + [T.StructField(n, T.LongType()) for n in ("n_test", "n_features")]
    + [T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType())))]
)

MODEL_METADATA = T.StructType([
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("n_features", T.LongType()),
    T.StructField("metrics", MODEL_METRICS),
    T.StructField("model_type", T.StringType()),
])
