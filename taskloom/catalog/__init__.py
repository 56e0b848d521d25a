from . import events, reports, workflows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
