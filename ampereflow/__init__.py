"""Spark DataFrame library for electricity-market series, documents and vectors."""
