"""Contigs that arrive over time."""
