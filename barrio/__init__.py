"""Place-data engine on Spark: ingest, classify, match, serve and audit places."""
