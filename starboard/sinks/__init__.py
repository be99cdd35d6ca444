"""Writing of files, catalogue tables, serving tables and JDBC tables."""
