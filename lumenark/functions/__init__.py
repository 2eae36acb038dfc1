"""Scalar rules as native column expressions."""
