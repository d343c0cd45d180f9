"""Operators for text and ranking data of language-model training; nothing outside imports them."""
