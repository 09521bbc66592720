"""The library's queries."""

from . import market, more, portfolio, screen, streams, texts  # noqa: F401
from . import panels, tracking  # noqa: F401, E402  after those that it goes on from
from .base import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
