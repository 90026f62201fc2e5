"""The registered queries over the supplied tables, and the SQL each is checked against."""
