"""All queries of the library: importing a module of queries registers them."""

from __future__ import annotations

from . import behaviour, declared, evaluated, reconciled, witnessed  # noqa: F401
from .queries import ORACLE, QUERIES  # noqa: F401
