"""A Spark-native engine for ordered event streams: curation, features, labels, folds, models, simulation, lake."""
