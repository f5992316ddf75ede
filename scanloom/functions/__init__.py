"""Column helpers and fixed catalogs shared by the operators."""
