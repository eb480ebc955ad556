"""Operators over message relations."""
