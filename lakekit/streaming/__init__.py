"""Checkpointed streams: append, refresh, windowed rates, sustained alerts, keyed upsert."""
