"""Part of the vicinity package."""
