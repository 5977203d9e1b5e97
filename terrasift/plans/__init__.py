"""Queries bound to the test tables, with their SQL, and the run over whole cities."""
