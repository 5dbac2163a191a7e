"""Operators for preparing text training data at corpus scale."""
