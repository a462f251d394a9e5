"""Operators for preparing training corpora; see `queries` for the registered ones."""
