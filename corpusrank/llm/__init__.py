"""Operators for preparing language-model training data; nothing else in corpusrank imports this subpackage."""
