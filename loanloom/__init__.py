"""loanloom: retail-credit portfolio analytics on Spark DataFrames."""

from loanloom.book import LoanBook

__all__ = ["LoanBook"]
