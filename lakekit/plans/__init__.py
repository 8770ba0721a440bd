"""Readiness collectors and the reporting queries over their snapshots."""
