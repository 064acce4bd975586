"""Importing this module registers every query."""

from dimloom.plans import checks, dims, facts, profiles, reports, statements, streams, views  # noqa: F401
