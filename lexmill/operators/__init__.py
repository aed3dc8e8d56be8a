"""DataFrame -> DataFrame jobs, one module per operator family."""
