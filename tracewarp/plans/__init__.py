"""SQL dialect, query catalogue and their plans."""
