"""Operators from DataFrame to DataFrame; columns are named by parameters."""
