"""Incident analytics expressed as Spark DataFrame plans."""
