"""Scans and loaders."""
