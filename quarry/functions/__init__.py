"""Column functions: URLs, patterns, statuses."""
