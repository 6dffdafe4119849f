"""Readers and writers of word lists, messages and reports."""
