"""Spark-first analytics over media inventories: plans, reports and searches as DataFrames."""
