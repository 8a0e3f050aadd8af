"""Portfolio construction and risk analytics over long-format tables, as Spark plans."""
