"""Column functions. Everything here is a native expression; no Python UDF."""
