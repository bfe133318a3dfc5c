"""Streaming entity-coreference analytics on PySpark."""
