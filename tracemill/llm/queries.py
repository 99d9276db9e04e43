"""All registered queries of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

import tracemill.llm
from tracemill.llm.common import ORACLES, QUERIES

for _module in pkgutil.iter_modules(tracemill.llm.__path__):
    if _module.name != "queries":
        importlib.import_module(f"tracemill.llm.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
