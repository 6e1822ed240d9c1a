"""The queries that are checked against SQL, and the SQL they are checked with."""
