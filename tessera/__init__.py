"""Address data quality, entity matching and geo-search as Spark plans."""
