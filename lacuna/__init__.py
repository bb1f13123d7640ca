"""Spark-native reconciliation and gap analysis."""
