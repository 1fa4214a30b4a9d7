"""Operators that prepare language-model training data; the rest of the library does not import this subpackage."""
