"""Operators for building training data from clippings; nothing outside this subpackage imports it."""
