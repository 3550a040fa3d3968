"""Every query by name: a callable from (session, folder of raw tables) to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom import schemas
from loanloom.book import GappyBook, LoanBook, shared_folder
from loanloom.functions.ordered import fill_median
from loanloom.functions.rounding import settle
from loanloom.operators import (clustering, explain, export, gold, modelling, policy, portfolio,
                                profile, quality, reports, scoring, silver, stats)
from loanloom.sources import catalog, ingest, sinks
from loanloom.sources.tables import read_csv, read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
# what each query does with a book, whichever it is
_builds: dict[str, Callable[[LoanBook], DataFrame]] = {}

# fits of the application, the oldest of which give way
KEPT_FITS = 8
_fits: dict[tuple, object] = {}


def query(name: str):
    """Register a function of a loan book; floating columns are settled to six digits."""
    def add(build: Callable[[LoanBook], DataFrame]):
        _builds[name] = build
        QUERIES[name] = lambda spark, folder: settle(build(LoanBook(spark, folder)))
        return build
    return add


def _over(name: str, layer: Callable[[LoanBook], DataFrame], operator: Callable[[DataFrame], DataFrame]):
    query(name)(lambda book: operator(layer(book)))


def _raw(book: LoanBook, name: str) -> DataFrame:
    return read_table(book.spark, book.folder, name)


def _once_fitted(name: str, silver: DataFrame, fit: Callable[[DataFrame], object]):
    """The result of ``fit``, shared by the queries of an application that read the same silver files."""
    slot = _slot(name, silver)
    if slot not in _fits:
        while len(_fits) >= KEPT_FITS:
            _fits.pop(next(iter(_fits)))
        _fits[slot] = fit(silver)
    return _fits[slot]


def _slot(name: str, silver: DataFrame) -> tuple:
    return (name, silver.sparkSession.sparkContext.applicationId, *sorted(silver.inputFiles()))


def _trained(silver: DataFrame):
    return _once_fitted("trained", silver, modelling.train_and_evaluate)


def _sweep_fits(silver: DataFrame) -> modelling.Sweep:
    return _once_fitted("sweep", silver, modelling.sweep)


def _sweep(silver: DataFrame) -> DataFrame:
    return _sweep_fits(silver).table


def _tuned(silver: DataFrame):
    """The sweep's winner, and its metrics at the default and its best cut-off."""
    weight = modelling.best_weight(_sweep(silver)).first()["scale_pos_weight"]
    fitted = _fits.get(_slot("sweep", silver))
    return modelling.tuned_model(silver, weight, threshold=None, model=fitted.models.get(weight) if fitted else None)


def _borrowers(book):
    return book.operational("borrowers")


def _segments(book):
    return book.operational("risk_segments")


def _fact(book):
    return book.gold("fact_credit_risk")


def _silver(book):
    return book.silver()


def _scored(book):
    return book.scored()


def _scored_by_id(book):
    return book.scored().withColumn("borrower_id", F.col(K.KEY))


# ---- source files and cleaning -----------------------------------------------------------
query("bank_file")(lambda book: book.bank())
query("bureau_file")(lambda book: book.bureau())
query("borrower_records")(lambda book: book.records().select(*book.bank().columns,
                                                               "Credit_Score", "Approved_Flag"))
query("drop_metadata")(lambda book: ingest.with_metadata(book.bank(), "bank")
                       .transform(silver.drop_metadata))
query("tagged_rows")(lambda book: ingest.with_metadata(book.bureau(), ingest.SOURCE_TAGS["cibil_external"])
                     .groupBy("_source").agg(F.count("*").alias("row_count"),
                                             F.countDistinct("_ingested_at").alias("ingest_times")))
_over("encoded_target", LoanBook.bureau, lambda df: silver.encode_target(df).select(
    K.KEY, "Approved_Flag", "risk_grade", K.TARGET))
query("clean_sentinels")(lambda book: silver.clean_sentinels(book.bank()))
query("clean_categories")(lambda book: silver.clean_categories(book.bureau()).select(
    K.KEY, "MARITALSTATUS", "EDUCATION", "GENDER", "last_prod_enq2", "first_prod_enq2"))
query("category_counts")(lambda book: silver.category_counts(
    book.bureau(), silver.clean_categories(book.bureau()),
    ["MARITALSTATUS", "EDUCATION", "GENDER", "last_prod_enq2", "first_prod_enq2"]))
query("silver_features")(_silver)
_over("interaction_features", _silver, lambda df: silver.interaction_features(df).select(
    K.KEY, *K.ENGINEERED_FEATURES))
query("median_fill")(lambda book: fill_median(
    book.bank().select(K.KEY, *[F.nullif(F.col(c).cast("double"), F.lit(float(K.NOT_APPLICABLE))).alias(c)
                                for c in ("CC_utilization", "Age_Oldest_TL")]),
    ["CC_utilization", "Age_Oldest_TL"]))

GAPPY = ("CC_utilization", "PL_utilization", "Age_Oldest_TL", "Age_Newest_TL")
query("median_fill_all")(lambda book: fill_median(
    book.bank().select(K.KEY, *[F.nullif(F.col(c).cast("double"), F.lit(float(K.NOT_APPLICABLE))).alias(c) for c in GAPPY]), GAPPY))

# ---- files: what jobs and sinks stored, read back ------------------------------------------
def _target(book: LoanBook, name: str) -> str:
    """A new folder beside the written layers."""
    folder = shared_folder(book.spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder.rstrip('/')}/loanloom/{book.spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}/{name}"


@query("bank_csv")
def _bank_csv(book):
    path = _target(book, "bank.csv")
    sinks.write_csv(book.bank(), path)
    return read_csv(book.spark, path, schemas.BANK)


@query("bronze_bank")
def _bronze_bank(book):
    path = _target(book, "bank.csv")
    sinks.write_csv(book.bank(), path)
    return ingest.ingest_internal_bank(book.spark, path, _target(book, "bronze")).drop("_ingested_at")


@query("bronze_bureau")
def _bronze_bureau(book):
    path = _target(book, "bureau.parquet")
    sinks.write_parquet(book.bureau(), path)
    return ingest.ingest_bureau(book.spark, path, _target(book, "bronze")).drop("_ingested_at")


@query("bronze_applications")
def _bronze_applications(book):
    path = _target(book, "applications.csv")
    sinks.write_csv(_raw(book, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("Disbursed"), F.col("o_totalprice").alias("Loan_Amount_Applied"),
        *[F.lit(None).cast("double").alias(c) for c in schemas.LOAN_APPLICATIONS.fieldNames()[2:]]), path)
    stored = ingest.ingest_loan_applications(book.spark, path, _target(book, "bronze"))
    return ingest.application_summary(silver.drop_metadata(stored))


@query("silver_stored")
def _silver_stored(book):
    path = _target(book, "silver.parquet")
    sinks.write_silver(book.silver(), path)
    return sinks.read_silver(book.spark, path)


@query("metrics_stored")
def _metrics_stored(book):
    record, path = portfolio.portfolio_summary(book.scored()), _target(book, "metrics")
    sinks.write_json(record, path)
    return sinks.read_json(book.spark, path, record.schema)


@query("tables_exported")
def _tables_exported(book):
    """Rows and keys of every exported table."""
    tables = {f"exported_{name}": book.gold(name) for name in ("dim_borrower", "dim_credit", "dim_loan_portfolio", "fact_credit_risk")}
    catalog.register(tables)
    listed = [name for name in catalog.table_names(book.spark) if name in tables]
    paths = catalog.export_tables(book.spark, listed, _target(book, "gold"))
    counted = [book.spark.read.parquet(path).agg(
        F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.countDistinct("borrower_id").alias("borrowers"))
        for name, path in zip(listed, paths, strict=True)]
    return reduce(DataFrame.unionByName, counted)


@query("report_by_sql")
def _report_by_sql(book):
    catalog.register({"silver_for_sql": book.silver()})
    return catalog.run_sql(book.spark, """
        -- lines of comment are no part of a statement
        SELECT income_tier, cibil_band, count(*) AS borrowers, sum(default_risk) AS defaults
        FROM silver_for_sql GROUP BY income_tier, cibil_band;""")


# ---- star schema -------------------------------------------------------------------------
for _name in ("dim_borrower", "dim_credit", "dim_loan_portfolio", "fact_credit_risk"):
    query(_name)(lambda book, name=_name: book.gold(name))
for _name, _view in (("risk_by_score_band", gold.risk_by_score_band), ("risk_by_income", gold.risk_by_income),
                     ("risk_by_age", gold.risk_by_age), ("risk_by_gold_loan", gold.risk_by_gold_loan),
                     ("risk_by_education", gold.risk_by_education)):
    _over(_name, _fact, _view)
query("star_join")(lambda book: gold.star_join(
    book.gold("fact_credit_risk"), book.gold("dim_borrower"), book.gold("dim_credit"),
    book.gold("dim_loan_portfolio")))
query("risk_segments")(_segments)
query("delinquency_summary")(lambda book: book.operational("delinquency_summary"))

# ---- report library ------------------------------------------------------------------------
_over("portfolio_health", _borrowers, reports.portfolio_health)
_over("default_by_segment", _segments, reports.default_by_segment)
_over("enquiry_lift", _borrowers, reports.enquiry_lift)
_over("delinquency_funnel", _borrowers, reports.delinquency_funnel)
_over("history_vs_default", _borrowers, reports.history_vs_default)
_over("high_risk_rules", _borrowers, reports.high_risk_rules)
_over("income_vs_default", _borrowers, reports.income_vs_default)
_over("gold_loan_buckets", _borrowers, reports.gold_loan_buckets)
_over("early_intervention", _borrowers, reports.early_intervention)
_over("policy_impact", _borrowers, reports.policy_impact)

# ---- quality and profile ---------------------------------------------------------------------
_over("quality_checks", _silver, quality.quality_checks)
_over("quality_verdict", _silver, lambda df: quality.all_passed(quality.quality_checks(df)))
_over("duplicate_keys", LoanBook.bank, quality.duplicate_keys)
_over("encoding_direction", _silver, quality.encoding_direction)
query("key_reconciliation")(lambda book: quality.key_reconciliation(book.bank(), book.bureau()))
query("customer_order_keys")(lambda book: quality.key_reconciliation(
    _raw(book, "customer").select(F.col("c_custkey").alias(K.KEY)),
    _raw(book, "orders").select(F.col("o_custkey").alias(K.KEY))))
_over("sentinel_scan", LoanBook.raw, quality.sentinel_scan)
_over("sentinels_left", _silver, quality.sentinel_scan)
_over("column_profile", LoanBook.bureau, lambda df: profile.column_profile(df).select(
    "column_name", "data_type", "null_pct"))
query("events_profile")(lambda book: profile.column_profile(_raw(book, "events")).select(
    "column_name", "null_pct"))
_over("sample_scan", LoanBook.bank, lambda df: df.limit(5000).agg(F.count("*").alias("row_count")))
_over("describe_score_by_grade", _silver, lambda df: profile.describe_by(df, "Approved_Flag", "Credit_Score"))
_over("describe_income_by_grade", _silver, lambda df: profile.describe_by(df, "Approved_Flag", "NETMONTHLYINCOME"))
_over("describe_age_by_grade", _silver, lambda df: profile.describe_by(df, "Approved_Flag", "AGE"))
_over("describe_by_grade", _silver, lambda df: profile.describe_all(
    df, "Approved_Flag", ["Credit_Score", "NETMONTHLYINCOME", "AGE"]))
_over("grade_counts", LoanBook.bureau, ingest.grade_distribution)
_over("grade_means", _silver, lambda df: profile.means_by(
    df, "Approved_Flag", ["num_times_delinquent", "num_times_60p_dpd", "Tot_Missed_Pmnt"]))
_over("best_vs_worst_grade", _silver, lambda df: profile.compare_groups(
    df, "Approved_Flag", "P1", "P4",
    ["Credit_Score", "NETMONTHLYINCOME", "num_times_delinquent", "Tot_Missed_Pmnt", "Total_TL"]))
query("dictionary_search")(lambda book: profile.search(
    _raw(book, "documents"), "License|Copyright|Rights Reserved", ["text", "lang", "source"]).select("doc_id", "lang"))
query("ingest_summary_bank")(lambda book: ingest.summarise("internal_bank", book.bank()))
query("ingest_summary_bureau")(lambda book: ingest.summarise("cibil_external", book.bureau()))
query("application_summary")(lambda book: ingest.application_summary(_raw(book, "orders").select(
    (F.col("o_orderstatus") == "F").cast("int").alias("Disbursed"),
    F.col("o_totalprice").alias("Loan_Amount_Applied"))))

# ---- portfolio ---------------------------------------------------------------------------------
_over("rule_pd", _scored, lambda df: df.select(K.KEY, "predicted_pd"))
_over("portfolio_summary", _scored, portfolio.portfolio_summary)
_over("headline_kpis", _scored, portfolio.headline_kpis)
_over("pd_band_distribution", _scored, portfolio.pd_band_distribution)
_over("segment_rates_age", _scored, lambda df: portfolio.segment_default_rates(df, "AGE", *K.LEADERBOARD_AGE_BAND))
_over("segment_rates_income", _scored, lambda df: portfolio.segment_default_rates(
    df, "NETMONTHLYINCOME", *K.LEADERBOARD_INCOME_BAND))
_over("segment_rates_tier", _scored, lambda df: portfolio.segment_default_rates(df, "income_tier"))
for _dim in ("enquiry", "age", "income", "history"):
    _over(f"segment_contribution_{_dim}", _borrowers,
          lambda df, dim=_dim: portfolio.segment_contribution(df, dim))
_over("expected_loss_by_segment", _scored, lambda df: portfolio.expected_loss_by_segment(df, "cibil_band"))
_over("expected_loss_by_age", _scored, lambda df: portfolio.expected_loss_by_segment(
    df, "AGE", *K.LEADERBOARD_AGE_BAND))
_over("riskiest_segments", _silver, portfolio.riskiest_segments)
_over("income_chart", _borrowers, portfolio.income_chart)
_over("funnel_transitions", _borrowers, portfolio.funnel_transitions)
_over("pd_histogram", _scored, portfolio.pd_histogram)
_over("watchlist", _borrowers, portfolio.watchlist)
_over("watchlist_priorities", _borrowers, lambda df: portfolio.watchlist_priorities(portfolio.watchlist(df)))
_over("distinct_education", LoanBook.bureau, lambda df: portfolio.distinct_labels(df, "EDUCATION"))
_over("scored_export", _scored, lambda df: export.scored_export(df).select(
    K.KEY, *export.BUSINESS_COLUMNS, "enquiry_value", "delinquency_value"))
_over("portfolio_ranks", _scored, lambda df: export.ranks(export.loss_columns(df)).select(
    K.KEY, "risk_rank", "loss_rank"))
_over("export_bands", _scored, lambda df: quality.blank_bands(export.band_columns(df)))
_over("export_summary", _scored, lambda df: export.export_summary(
    df.transform(export.decision_flags).transform(export.loss_columns)))

# ---- scoring and policy ----------------------------------------------------------------------------
_over("confusion_matrix", _scored, scoring.confusion_matrix)
_over("auc_exact", _scored, scoring.auc)
_over("roc_points", _scored, scoring.roc_points)
_over("roc_points_full", _scored, lambda df: scoring.roc_points(df, drop_collinear=False))
_over("pr_points", _scored, scoring.pr_points)
_over("average_precision", _scored, scoring.average_precision)
_over("single_feature_auc", _scored, lambda df: scoring.single_feature_auc(df, [*K.FEATURES, K.SCORE_FEATURE]))
_over("leakage_gate", _scored, lambda df: quality.leakage_gate(
    scoring.single_feature_auc(df, [*K.FEATURES, K.SCORE_FEATURE])))
_over("threshold_table", _scored, scoring.threshold_table)
_over("threshold_display", _scored, scoring.threshold_display)
_over("threshold_sweep", _scored, scoring.threshold_sweep)
_over("best_threshold", _scored, lambda df: scoring.best_threshold(scoring.threshold_sweep(df)))
_over("policy_approvals", _scored, lambda df: policy.apply_policy(df, policy.CONSERVATIVE).select(
    K.KEY, "approved"))
_over("policy_simulation", _scored, lambda df: policy.simulate_policies(df, policy.PRESETS))
_over("policy_vs_baseline", _scored, lambda df: policy.simulate_policy(
    df, policy.CONSERVATIVE, policy.RECOMMENDED))
_over("policy_comparison", _scored, policy.compare_policies)
_over("policy_before_after", _scored, lambda df: policy.before_and_after(
    df, policy.from_sliders(0.50, max_enq_6m=4, max_delinquencies=20, min_monthly_income=10000)))

# ---- statistics --------------------------------------------------------------------------------------
_over("score_band_table", _fact, stats.score_band_table)
_over("steepest_band", _fact, lambda df: stats.steepest_band(stats.score_band_table(df)))
_over("gini_overall", _fact, stats.gini_overall)
_over("gini_income", _fact, lambda df: stats.gini(df, "monthly_income_inr"))
_over("gini_by_tier", _fact, stats.gini_by_tier)
_over("risky_vs_safe", _fact, stats.risky_vs_safe)
_over("gold_vs_non_gold", _fact, stats.gold_vs_non_gold)
_over("ttest_gold", _fact, stats.ttest_gold)
_over("early_warning_signals", _fact, stats.early_warning_signals)
_over("signal_p_values", _fact, stats.signal_p_values)
_over("signals_with_p_values", _fact, stats.signals_with_p_values)
_over("ttest_gold_p_value", _fact, stats.ttest_gold_p_value)

# ---- explanations --------------------------------------------------------------------------------------
_over("reason_codes", _scored_by_id, lambda df: explain.explain(df).select(
    "borrower_id", "predicted_pd_pct", "risk_level",
    F.array_join(F.col("risk_reasons.reason"), "; ").alias("risk_reasons"),
    F.array_join(F.col("protective_factors.reason"), "; ").alias("protective_factors"),
    "recommendation", "summary"))
_over("batch_explain", _scored_by_id, explain.batch_explain)
_over("application_reasons", _scored_by_id, explain.application_reasons)

# a linear card with fixed coefficients, so that reasons by attribution can be checked in SQL
CARD = {"enq_L6m": (0.30, 2.0), "num_times_delinquent": (0.25, 1.0), "num_times_60p_dpd": (0.40, 0.5),
        "missed_payment_ratio": (0.50, 0.25), "active_loan_ratio": (0.20, 0.5),
        "loan_type_diversity": (-0.15, 2.0), "Total_TL": (-0.10, 5.0), "Gold_TL": (0.10, 1.0)}


@query("attribution_reasons")
def _attribution_reasons(book):
    df = modelling.linear_attributions(_scored_by_id(book), CARD)
    told = explain.explain(df, {c: f"phi_{c}" for c in CARD}, top_n=2)
    return told.select("borrower_id", F.array_join(F.col("risk_reasons.feature"), ",").alias("risk_features"),
                       F.array_join(F.col("protective_factors.feature"), ",").alias("safe_features"),
                       F.array_join(F.col("risk_reasons.reason"), "; ").alias("risk_reasons"))


query("card_attributions")(lambda book: modelling.linear_attributions(book.silver(), CARD).select(
    K.KEY, *[f"phi_{c}" for c in CARD]))
query("card_importance")(lambda book: modelling.importance(
    modelling.linear_attributions(book.silver(), CARD), list(CARD)).drop("built_in_importance"))

# ---- models: rows only, MLlib's numbers have no SQL equivalent ---------------------------------------------
_over("gbt_metrics", _silver, lambda df: _trained(df)[1])


@query("gbt_scores")
def _gbt_scores(book):
    model, _ = _trained(book.silver())
    return modelling.score(book.silver(), model).select(K.KEY, K.TARGET, "predicted_pd")


@query("cross_validation")
def _cross_validation(book):
    train, _ = modelling.train_test(modelling.feature_matrix(book.silver()))
    found = modelling.cross_validate(train)
    return train.agg(F.count("*").alias("n_train")).withColumns({k: F.lit(v) for k, v in found.items()})


_over("weight_sweep", _silver, _sweep)
_over("best_weight", _silver, lambda df: modelling.best_weight(_sweep(df)))
_over("tuned_model", _silver, lambda df: _tuned(df)[1])
_over("first_splits", _silver, modelling.first_splits)
_over("model_comparison", _silver, modelling.model_comparison)


@query("attributions")
def _attributions(book):
    matrix = modelling.feature_matrix(book.silver())
    return modelling.attributions(matrix, modelling.logistic_model(matrix))


@query("importance")
def _importance(book):
    matrix = modelling.feature_matrix(book.silver())
    model, _ = _trained(book.silver())
    features = modelling.model_inputs(matrix)
    linear = modelling.attributions(matrix, modelling.logistic_model(matrix))
    return modelling.importance(linear, features, model)


query("train_test_sizes")(lambda book: _split_sizes(modelling.feature_matrix(book.silver())))


def _split_sizes(matrix: DataFrame) -> DataFrame:
    train, test = modelling.train_test(matrix)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.avg(K.TARGET).alias("default_rate"))


@query("fold_sizes")
def _fold_sizes(book):
    train, _ = modelling.train_test(modelling.feature_matrix(book.silver()))
    return modelling.folded(train).groupBy(F.col(modelling.PART).alias("fold"), K.TARGET).agg(
        F.count("*").alias("n"), F.sum(F.col(K.KEY)).alias("key_sum"))


_over("standardised", _fact, lambda df: clustering.standardised(df).select("borrower_id", *clustering.scaled_names()))
_over("cluster_iteration", _fact, clustering.one_iteration)
_over("borrower_clusters", _fact, clustering.borrower_segments)

# ---- books with gaps: the same operators where incomes, ages, labels, loan counts or utilisation are missing ----
GAPPY_QUERIES = (
    "silver_features", "clean_categories", "quality_checks", "default_by_segment", "income_vs_default", "gold_loan_buckets",
    "early_intervention", "risk_by_age", "risk_by_education", "risky_vs_safe", "early_warning_signals", "describe_income_by_grade",
    "column_profile", "portfolio_summary", "headline_kpis", "segment_rates_age", "segment_rates_income", "segment_contribution_age",
    "segment_contribution_income", "expected_loss_by_segment", "expected_loss_by_age", "export_bands", "reason_codes",
    "policy_simulation", "policy_vs_baseline", "policy_comparison", "policy_before_after")
for _name in GAPPY_QUERIES:
    QUERIES[f"{_name}_gappy"] = lambda spark, folder, build=_builds[_name]: settle(build(GappyBook(spark, folder)))
