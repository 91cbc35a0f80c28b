"""Registered queries and their SQL."""

from docketspark.plans import registry  # noqa: F401  the others import it, and it imports them
