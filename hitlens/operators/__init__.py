"""DataFrame -> DataFrame operators of the statistics job, hit ingestion,
the registry and load-test statistics."""
