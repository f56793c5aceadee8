"""The worksheet functions; importing this package fills the registry."""

from . import dates, engineering, finance, logical, maths, statistics, texts  # noqa: F401
from .core import REGISTRY, V, apply, call, error, lit

__all__ = ["REGISTRY", "V", "apply", "call", "error", "lit"]
