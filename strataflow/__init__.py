"""strataflow: Spark-native analytics over wide numeric event data and training-data tables."""

__version__ = "0.1.0"
