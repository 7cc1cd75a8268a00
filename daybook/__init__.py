"""Session-history engine on Spark: ingest, redact, index and query append-only journals."""
