"""Column functions: markup reading, props, rule matching, paths."""
