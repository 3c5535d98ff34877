"""Document analytics on Spark: evidence spans, scores and evaluation as DataFrame plans."""
