"""Schemas of stored tables, as DDL."""

PRICES = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double"
FUNDAMENTALS = "symbol string, field string, value double, period_end date, filed date, form string, fiscal_year int, fiscal_period string"
FACTOR_DAYS = "date date, mkt_rf double, smb double, hml double, rf double, mom double"
SCORES = "symbol string, score double"
WEIGHTS = "symbol string, weight double"
#: The fields of a fundamentals cross-section, and those reported for the year only.
FIELDS = ("book_equity", "net_income", "revenue", "gross_profit", "assets", "liabilities", "shares_outstanding")
ANNUAL_ONLY = ("net_income", "revenue", "gross_profit")
#: Style factors, in the order of a factor model's columns.
STYLES = ("value", "momentum", "size", "quality", "low_vol")
