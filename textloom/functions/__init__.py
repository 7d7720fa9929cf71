"""textloom."""
