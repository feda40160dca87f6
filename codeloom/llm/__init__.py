"""Operators over texts and source files for training data. Nothing outside imports this."""
