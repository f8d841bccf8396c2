"""Operators for preparing large text corpora; nothing outside this folder imports them."""
