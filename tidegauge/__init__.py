"""Tidegauge: a Spark-first engine for Bayesian time-series analytics at panel scale."""
