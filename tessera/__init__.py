"""Tessera: document retrieval and evaluation as Spark plans."""
