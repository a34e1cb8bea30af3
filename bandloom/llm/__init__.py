"""Operators for building training corpora; their queries are in ``bandloom.llm.queries``."""
