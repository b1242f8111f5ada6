"""Registered queries and whole jobs."""

from . import more, registry  # noqa: F401  more adds its queries to the registry's
