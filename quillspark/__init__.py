"""Stylometric analytics over Spark DataFrames."""
