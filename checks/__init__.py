"""Registered queries, the tables derived for them, and the SQL they are checked against."""
