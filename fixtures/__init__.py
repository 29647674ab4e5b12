"""Inputs derived from the test tables, for the registered queries, the tests and the bench."""
