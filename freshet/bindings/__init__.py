"""The analysis tables as views over the given test tables, with check SQL."""
