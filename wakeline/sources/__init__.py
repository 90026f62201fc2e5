"""Readers: stored tables and API payloads that land as JSON text."""
