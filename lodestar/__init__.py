"""Graph-aware object analytics on PySpark."""
