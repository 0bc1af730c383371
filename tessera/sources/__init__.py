"""Sources of the tessera package."""
