"""Column expressions: predicates, casts, text and date functions. Nothing here runs a job."""
