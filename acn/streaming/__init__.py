"""All inputs of this analysis are finite tables: it has no streaming operators."""
