"""The operators bound to the standard tables, with the SQL that gives the same rows."""
