"""Operators for preparing large text corpora; nothing else in geoloom imports this subpackage."""
