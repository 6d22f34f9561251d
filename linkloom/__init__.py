"""Record linkage across noisy business directories on Spark."""
