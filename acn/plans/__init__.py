"""Whole analyses as compositions of operators."""
