"""Several operators put together: rule runs, transform sequences and guarded SQL."""
