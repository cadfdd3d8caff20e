"""Spark-native contact, outreach and text-table operators."""
