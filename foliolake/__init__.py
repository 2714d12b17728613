"""foliolake: Spark-native analytics over libraries of presentation-style documents."""

__version__ = "0.1.0"
