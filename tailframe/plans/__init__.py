"""tailframe plans."""
