"""Spark-native data processing for a multi-tenant media pipeline."""
