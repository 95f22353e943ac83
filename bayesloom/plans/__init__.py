"""Queries, planner rewrites and the model API."""
