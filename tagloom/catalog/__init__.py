"""Named queries over the standard test tables and their SQL twins."""
