"""Catalog, knowledge-graph and document operators as Spark plans."""
