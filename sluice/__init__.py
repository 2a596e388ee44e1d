"""Flow analytics on Spark: allowlists from sampled flow records, filter evaluation, parameter selection, reports."""
