"""The registered queries and the batch job built from the operators."""
