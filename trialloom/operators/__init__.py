"""DataFrame -> DataFrame operators. None collects, none reads the clock."""
