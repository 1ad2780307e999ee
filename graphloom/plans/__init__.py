"""Drivers of iterative plans."""
