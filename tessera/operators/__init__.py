"""Joins, tilings, folds and catalogue analytics on DataFrames."""
