"""Registered queries and their SQL counterparts over the provided tables."""
