"""SQL answers the registered queries are checked against."""

from . import content as _content, discovery as _discovery, ranking as _ranking, store as _store  # noqa: F401
from .base import ORACLES  # noqa: F401
