"""Whole scans composed from the operators."""
