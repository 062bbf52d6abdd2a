"""streamql.plans."""
