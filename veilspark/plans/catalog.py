"""Imports every query module so the registry is complete."""

from __future__ import annotations

from . import q_decode, q_eval, q_io, q_misc, q_stream, q_text  # noqa: F401
from .q_text import flagship  # noqa: F401
from . import oracle_spans  # noqa: F401,E402  (adds SQL twins to registered queries)
from .registry import ORACLES, QUERIES  # noqa: F401
