"""Checks of the library: derived corpus, registered queries and their SQL counterparts."""
