"""Jobs composed of operators: ingest, snapshot changes, audits."""
