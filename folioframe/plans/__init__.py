"""Named queries with their SQL oracles."""
