"""Views over the test tables, registered queries and their SQL twins."""
