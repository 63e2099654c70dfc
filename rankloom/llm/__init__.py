"""Operators for preparing training text: scans, mixing, token stores, dedup, models, rollups."""
