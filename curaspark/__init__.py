"""Media similarity and curation operators expressed as Spark DataFrame jobs."""
