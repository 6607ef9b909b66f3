"""Queries: each applies an operator to the test tables and carries equivalent SQL where SQL can say it."""
