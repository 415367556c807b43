"""Structured Streaming counterparts of stateful operators."""
