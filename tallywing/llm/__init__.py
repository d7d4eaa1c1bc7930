"""Operators for preparing training corpora: one module per operator, ``queries`` registers them."""
