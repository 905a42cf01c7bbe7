"""Ledgerloom: document-to-graph analytics as Spark DataFrame and SQL jobs."""
