"""The queries of this subpackage (its ``q_`` modules) and the SQL of those that SQL can express."""

from __future__ import annotations

import pkgutil
from importlib import import_module

import tidemark.llm as _home

_MODULES = [import_module(f"{_home.__name__}.{m.name}") for m in pkgutil.iter_modules(_home.__path__) if m.name.startswith("q_")]

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.ORACLE for m in _MODULES if getattr(m, "ORACLE", None)}
