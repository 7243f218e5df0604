"""Registered queries over the test tables, each with the SQL that checks it."""

from .base import REGISTRY, Tables

from . import (aggregates, catalogs, loads, meaning, quality, sourcing, streams,  # noqa: F401,E402
               telemetry)

__all__ = ["REGISTRY", "Tables"]
