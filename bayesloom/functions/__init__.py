"""Column functions: random draws, densities, divergences, text keys."""
