"""barfold: daily market-data curation and walk-forward evaluation as Spark jobs."""
