"""Column expressions on racing values.  All are native: no Python runs on rows."""
