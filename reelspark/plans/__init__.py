"""Registered queries of the media operators on the test tables: QUERIES, and the SQL for the same rows, ORACLE_SQL."""

from . import audio_cases, block_cases, colour_cases, container_cases, geometry_cases, movfile_cases, naming_cases, stream_cases  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
