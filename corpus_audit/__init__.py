"""corpus_audit: audit large text and source corpora with plain Spark DataFrame jobs."""
