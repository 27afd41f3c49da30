"""Relational operators over files, lines, symbols, chunks and vectors."""
