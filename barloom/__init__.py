"""barloom: event studies on market bar tables, written as PySpark jobs."""

from barloom.schemas import SessionSpec

__all__ = ["SessionSpec"]
