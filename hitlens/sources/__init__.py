"""Readers, the mapping of the driver's tables onto this package's model, and sinks."""

from .tables import read_table
from . import model, sinks

__all__ = ["read_table", "model", "sinks"]
