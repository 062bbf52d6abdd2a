"""streamql.operators."""
