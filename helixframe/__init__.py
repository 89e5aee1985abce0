"""Mutation-data features, evaluation and ensembling on Spark DataFrames."""
