"""SQL the registered queries are checked against."""
