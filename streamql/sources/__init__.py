"""streamql.sources."""
