"""Session analytics on Spark: co-visitation, candidates, features, experiments, drift."""
