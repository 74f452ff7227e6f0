"""Named queries over the test tables, each with the SQL it is checked against."""
