"""Spark-native analytics for news-derived temporal knowledge graphs."""
