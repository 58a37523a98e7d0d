"""Threat-scoring analytics expressed as Spark DataFrame plans."""
