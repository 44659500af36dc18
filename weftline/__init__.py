"""weftline: Spark-native data-lineage analytics."""

__version__ = "0.1.0"
