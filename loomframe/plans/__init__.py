"""The SQL dialect: its own parser, planned onto DataFrames."""
