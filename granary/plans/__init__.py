"""Named queries of the core, and the SQL they are checked against."""
