"""dayfold: daily behaviour features, leakage-aware folds, priors and blends as Spark jobs."""
