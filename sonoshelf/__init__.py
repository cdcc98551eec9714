"""Search, rollup and pipeline analytics over a spoken-word corpus, as Spark DataFrame plans."""
