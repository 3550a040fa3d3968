import pytest

from loanloom.operators import portfolio, stats
from loanloom.operators.display import LOOKS, displayed
from loanloom.plans.queries import QUERIES


def test_titles_and_rounding(book):
    plain = portfolio.expected_loss_by_segment(book.scored(), "cibil_band")
    shown = displayed("expected_loss_by_segment", plain)
    assert shown.columns == ["Segment", "Count", "Avg PD %", "EAD (₹ Cr)", "Expected Loss (₹ Cr)", "EL Rate %"]
    rates = {r["segment"]: r["el_rate_pct"] for r in plain.collect()}
    for row in shown.collect():
        assert row["EL Rate %"] == pytest.approx(rates[row["Segment"]], abs=0.005001)


@pytest.mark.parametrize("name", sorted(set(LOOKS) & set(QUERIES) - {"borrower_clusters"}))
def test_every_look_fits_its_query(spark, folder, name):
    columns = set(QUERIES[name](spark, folder).columns)
    look = LOOKS[name]
    assert set(look.digits) - {"p_value"} <= columns and set(look.titles) <= columns


def test_signals_carry_p_values(book):
    rows = stats.signals_with_p_values(book.gold("fact_credit_risk")).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(r["significant"] and r["p_value"] < 0.05 for r in rows)
