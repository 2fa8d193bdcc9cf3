"""Scans and sinks (S1-S9) plus the stand-in inputs derived from the driver tables."""
