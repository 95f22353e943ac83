"""Bayesian networks over DataFrames: learning, inference, sampling, updates and evaluation on Spark."""
