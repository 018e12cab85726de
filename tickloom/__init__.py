"""tickloom: daily market-data features as Spark jobs."""
