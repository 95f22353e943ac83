"""Relational operators: tables, factors, particles, graphs, summaries."""
