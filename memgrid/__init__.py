"""Retrieval, similarity, graph, event and lifecycle analytics as Spark DataFrame functions."""
