"""The registered queries and their independent SQL."""
