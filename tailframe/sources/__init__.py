"""tailframe sources."""
