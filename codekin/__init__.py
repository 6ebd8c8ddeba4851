"""codekin: Spark-native analytics for finding re-used code across large sets of binaries."""

__version__ = "0.1.0"
