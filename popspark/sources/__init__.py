"""Readers of variant, reference, mask, layout and model files."""
