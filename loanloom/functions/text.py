"""Text clean-up and search on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(column: Column) -> Column:
    """Capital at the start of every run of letters, so ``post-graduate`` -> ``Post-Graduate``."""
    runs = F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def present_text(column: Column, null_text: str = "nan") -> Column:
    """Trimmed text; NULL turns into a visible word before any case rule applies."""
    return F.trim(F.coalesce(column.cast("string"), F.lit(null_text)))


def any_matches(names: Iterable[str], pattern: str) -> Column:
    """True when any of the columns, read as text, contains the pattern in any case."""
    texts = F.array(*[F.col(name).cast("string") for name in names])
    return F.coalesce(F.exists(texts, lambda text: text.rlike(f"(?i){pattern}")), F.lit(False))
