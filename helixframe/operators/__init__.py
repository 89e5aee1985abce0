"""Operators over variant relations."""
