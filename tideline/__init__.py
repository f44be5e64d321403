"""Commerce analytics on Spark: sales, margin, ranking, stock and snapshots as DataFrame plans."""
