"""DataFrame operators: staging, sessions, as-of joins, windows, keys, search."""
