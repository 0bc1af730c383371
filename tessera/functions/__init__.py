"""Functions of the tessera package."""
