"""Identifier-span analytics, record normalisation and evaluation on Spark DataFrames."""
