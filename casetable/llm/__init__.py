"""Operators for preparing training data: text, chat, dedup, search, packing and archives."""
