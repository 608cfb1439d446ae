"""Streaming and replay sources."""
