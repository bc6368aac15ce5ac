"""Edge tables from files, literals and the test tables."""
