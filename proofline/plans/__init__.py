"""Multi-step jobs built from the operators: cohorts, datasets, maturity, training."""
