"""Operators that prepare documents for language-model training."""
