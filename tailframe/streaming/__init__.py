"""tailframe streaming."""
