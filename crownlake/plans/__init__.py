"""Whole plans made of operators, and helpers for long lineages."""
