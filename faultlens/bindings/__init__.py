"""Queries: operators bound to the fixture tables, each with its SQL equivalent."""
