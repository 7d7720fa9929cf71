"""Where a table lies, and how it is read."""
