"""Registered queries: the engine's operators run over the shared parquet tables."""
