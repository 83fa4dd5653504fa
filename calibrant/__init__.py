"""Retrieval evaluation with calibrated uncertainty, as Spark DataFrame plans."""
