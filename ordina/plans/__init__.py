"""Compositions of operators: stages, provenance and the registered queries."""
