"""streamql.functions."""
