"""Operators: each takes and returns DataFrames keyed by sample_id, chrom and, where rows are loci, pos."""
