"""The batch operators over arriving requests."""
