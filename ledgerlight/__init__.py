"""Retail KPI, insight and report-quality analytics on Spark DataFrames."""
