"""Readers and writers: sample tables, JSON messages, telegrams, test adapters."""
