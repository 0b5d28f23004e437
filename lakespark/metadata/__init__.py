"""Small JSON files that say which data files make up a version of a table."""
