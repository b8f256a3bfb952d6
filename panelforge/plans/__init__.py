"""Registered queries over the test tables, each beside the SQL that states it."""
