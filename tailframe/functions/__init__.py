"""tailframe functions."""
