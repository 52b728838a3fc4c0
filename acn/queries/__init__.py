"""Queries of the driver's contract over the genomic operators, each with the SQL that DuckDB runs where there is one."""
