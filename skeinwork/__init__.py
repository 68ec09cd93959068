"""Spark-first analytics over path graphs, reviewed baselines and delivered logs."""
