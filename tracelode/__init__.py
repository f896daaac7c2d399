"""Provenance-graph analytics as DataFrame operators on Apache Spark."""
