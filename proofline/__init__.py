"""Evidence analytics for machine-learning operations, expressed as Spark jobs."""
