"""Operators over text corpora and generated text; nothing else in the library imports this."""
