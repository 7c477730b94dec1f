"""Scans, the raw layer and run bookkeeping."""
