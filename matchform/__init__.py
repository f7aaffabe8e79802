"""Match-form analytics on Spark: features, validation and scoring for two-sided events."""
