"""codexlake: knowledge-archive search, ingestion and upkeep as Spark DataFrame operators."""
