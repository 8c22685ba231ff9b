"""Spark-native coverage reconciliation: client sales files against a measured-market panel."""
