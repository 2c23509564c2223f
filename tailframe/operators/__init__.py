"""tailframe operators."""
