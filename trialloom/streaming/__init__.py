"""Jobs fed by file streams."""
