"""Larkspan: decision support over open data as Spark DataFrame operators."""
