"""Operators for preparing training data of language models; nothing outside this subpackage imports it."""
