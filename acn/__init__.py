"""Allele-specific copy-number analysis of tumour cohorts, as Spark jobs over tables keyed by sample, chromosome and position."""
