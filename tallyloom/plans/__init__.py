"""Queries composed of the operators, by name, with the SQL that gives the same rows."""
