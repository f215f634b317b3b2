"""Outputs of an audit and of single commands."""
