"""The registered queries and, for each, the SQL that must give the same rows."""
