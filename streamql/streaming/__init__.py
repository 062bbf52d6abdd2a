"""streamql.streaming."""
