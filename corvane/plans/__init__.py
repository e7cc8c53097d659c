"""Compositions of operators: retrieval, answering, sweeps and the registered queries."""
