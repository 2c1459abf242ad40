"""Fields and schemas: what of a document is indexed, how, and what is kept."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import types as T

from .errors import SchemaError


@dataclass(frozen=True)
class FieldType:
    indexed: bool
    tokenized: bool
    stored: bool
    store_positions: bool
    boost: float
    analyzer_name: str | None

    def __post_init__(self) -> None:
        if isinstance(self.boost, bool) or not isinstance(self.boost, (int, float)) or not math.isfinite(self.boost) or self.boost <= 0:
            raise SchemaError("a field's boost must be a finite number above 0")
        if self.indexed and self.analyzer_name is None:
            raise SchemaError("an indexed field needs an analyzer")
        if self.store_positions and not self.indexed:
            raise SchemaError("only an indexed field has positions")
        object.__setattr__(self, "boost", float(self.boost))


def TextField(*, stored: bool = False, boost: float = 1.0) -> FieldType:
    """Cut into words, with positions."""
    return FieldType(True, True, stored, True, boost, "standard")


def KeywordField(*, stored: bool = False, boost: float = 1.0) -> FieldType:
    """Indexed whole, as it is."""
    return FieldType(True, False, stored, False, boost, "keyword")


def StoredField() -> FieldType:
    """Kept with the document, not searched."""
    return FieldType(False, False, True, False, 1.0, None)


class Schema(Mapping[str, FieldType]):
    """At least one field, in the order of names; equal schemas have equal fingerprints. Fields by a mapping or by keyword."""

    def __init__(self, given: Mapping[str, FieldType] | None = None, /, **more: FieldType):
        given = {**(given or {}), **more}
        if not given:
            raise SchemaError("a schema needs a field")
        for name, kind in given.items():
            if not isinstance(name, str) or not name:
                raise SchemaError("a field needs a name")
            if not isinstance(kind, FieldType):
                raise SchemaError(f"not a field type: {name}")
        self._fields = dict(sorted(given.items()))

    def __getitem__(self, name: str) -> FieldType:
        return self._fields[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._fields)

    def __len__(self) -> int:
        return len(self._fields)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self._fields == other._fields

    def __hash__(self) -> int:
        return hash(self.fingerprint)

    @property
    def indexed(self) -> list[str]:
        return [n for n, f in self.items() if f.indexed]

    @property
    def stored(self) -> list[str]:
        return [n for n, f in self.items() if f.stored]

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def to_dict(self) -> dict[str, dict]:
        return {n: asdict(f) for n, f in self.items()}

    @classmethod
    def from_dict(cls, given: Mapping[str, Mapping]) -> Schema:
        names = {f.name for f in fields(FieldType)}
        for name, kind in given.items():
            if set(kind) != names:
                raise SchemaError(f"field {name} must have exactly {sorted(names)}")
            for key, value in kind.items():
                want = str if key == "analyzer_name" else (int, float) if key == "boost" else bool
                if not isinstance(value, want) and not (key == "analyzer_name" and value is None):
                    raise SchemaError(f"{key} of field {name} has a wrong type")
        return cls({n: FieldType(**k) for n, k in given.items()})

    def struct(self) -> T.StructType:
        """One nullable string column a field; null: left out."""
        return T.StructType([T.StructField(n, T.StringType(), True, {"field": json.dumps(asdict(f))}) for n, f in self.items()])

    def check_document(self, values: Mapping[str, object]) -> dict[str, str]:
        for name, value in values.items():
            if name not in self:
                raise SchemaError(f"unknown field: {name}")
            if not isinstance(value, str):
                raise SchemaError(f"field {name} must be a string")
        return dict(sorted(values.items()))

    def check_columns(self, found: T.StructType) -> None:
        for f in found:
            if f.name not in self:
                raise SchemaError(f"unknown field: {f.name}")
            if not isinstance(f.dataType, T.StringType):
                raise SchemaError(f"field {f.name} must be a string")
