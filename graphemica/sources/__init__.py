"""Scans, sinks and the catalogue of character sets."""
