"""Reading of files, catalogue tables and JDBC tables."""
