"""Structured Streaming: stateful tracks, sinks and snapshots."""
