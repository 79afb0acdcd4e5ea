"""Adapters of all sources, by name."""

from plazaflow.sources import json_sources, page_sources  # noqa: F401
from plazaflow.sources.registry import ADAPTERS, extract, read_payload  # noqa: F401
