"""flowlens: traffic features, graph metrics and drift detection on Spark DataFrames."""
