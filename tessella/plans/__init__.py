"""The query catalogue: each operator over the test tables, with the same in SQL."""
