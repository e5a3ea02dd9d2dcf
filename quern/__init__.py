"""quern: a small PySpark-native analytics library (DataFrame in, DataFrame out)."""
