"""Operators on sparse tensors."""
