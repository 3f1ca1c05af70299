"""Mesh, sparse-algebra and geometry analytics expressed as Spark DataFrame queries."""
