"""Capacity-and-demand analytics on PySpark DataFrames."""
