"""Spark-native compaction analytics for captured command output."""
