"""Mining data streams on Spark: incremental learners, drift detectors, clusterers and their evaluation."""
