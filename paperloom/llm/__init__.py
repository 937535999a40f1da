"""Operators for preparing training corpora. Nothing else in paperloom imports this subpackage."""
