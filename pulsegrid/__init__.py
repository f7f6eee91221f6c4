"""Event-tempo analytics on Spark: ordered-sequence, signal and evaluation operators keyed by track."""
