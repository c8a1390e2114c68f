"""All registered queries; importing this package fills the registry."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import pages, relational, rollups, streams, texts, warehouse  # noqa: F401,E402
