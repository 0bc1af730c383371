"""Streaming of the tessera package."""
