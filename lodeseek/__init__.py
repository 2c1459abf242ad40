"""Lodeseek: full-text search and ranking on Spark DataFrames."""

from .operators.snapshot import IndexSnapshot
from .schema import FieldType, KeywordField, Schema, StoredField, TextField
from .sources.memory import MemoryIndex
from .sources.store import Index

#: A reader of an index is a snapshot of it.
IndexReader = IndexSnapshot
__version__ = "0.2.0"
__all__ = ["FieldType", "Index", "IndexReader", "IndexSnapshot", "KeywordField", "MemoryIndex", "Schema", "StoredField", "TextField", "__version__"]
