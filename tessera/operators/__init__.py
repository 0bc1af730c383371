"""Operators of the tessera package."""
