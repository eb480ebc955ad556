"""Readers and writers of mail containers."""
