"""Operators for preparing training data at corpus scale; nothing else in the package imports them."""
