"""Declared schemas: which fields a collection has, of which kind, and what each may be used for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .errors import InvalidSchema, NotAStruct

#: The synthetic field that stands for the record's key in filters and orders.
KEY = "$key"

INTEGERS = {"int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1)}
FLOATS = ("float32", "float64")
SCALARS = ("bool", *INTEGERS, *FLOATS, "string", "time")
OPAQUE = ("binary", "map", "struct")
INDEX_KINDS = (None, "index", "unique", "measure")

_SPARK = {
    T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64",
    T.StringType: "string", T.TimestampType: "time", T.TimestampNTZType: "time", T.BinaryType: "binary", T.MapType: "map", T.StructType: "struct",
}


@dataclass(frozen=True)
class Field:
    """A field: its kind, whether it is an array of that kind, whether it may be null, and how it is indexed.

    ``projection`` is a column that stands for an opaque field in queries (always compared as a string); ``aliases`` are
    further names by which patches may call the field, ``json`` the name that JSON patches give it.
    """

    name: str
    kind: str
    index: str | None = "index"
    array: bool = False
    nullable: bool = True
    aliases: tuple[str, ...] = ()
    json: str | None = None
    projection: Column | None = field(default=None, compare=False)
    naive: bool = False

    def __post_init__(self):
        if self.name == KEY:
            raise InvalidSchema(f"{KEY} is reserved")
        if self.index not in INDEX_KINDS:
            raise InvalidSchema(f"{self.name}: unknown index kind {self.index!r}")
        if self.kind not in (*SCALARS, *OPAQUE):
            raise InvalidSchema(f"{self.name}: unsupported kind {self.kind!r}")
        if self.index and self.kind in OPAQUE and self.projection is None:
            raise InvalidSchema(f"{self.name}: a {self.kind} field can't be indexed")
        if self.index == "unique" and self.array:
            raise InvalidSchema(f"{self.name}: an array can't be unique")
        if self.index == "measure" and (self.array or not self.numeric):
            raise InvalidSchema(f"{self.name}: a measure must be a number")

    @property
    def compared(self) -> str:
        """The kind that queries see."""
        return "string" if self.projection is not None else self.kind

    @property
    def numeric(self) -> bool:
        return self.projection is None and (self.kind in INTEGERS or self.kind in FLOATS)

    @property
    def queryable(self) -> bool:
        return self.index in ("index", "unique")


@dataclass(frozen=True)
class Schema:
    """A collection's name, the column and kind of its key, and its fields."""

    name: str
    key: str
    key_kind: str
    fields: tuple[Field, ...]
    string_key_index: bool = False

    def __post_init__(self):
        if not self.fields:
            raise NotAStruct(f"{self.name}: no fields")
        if self.key_kind not in ("int64", "uint64", "string"):
            raise InvalidSchema(f"{self.name}: keys are integers or strings, not {self.key_kind}")
        seen: set[str] = set()
        for f in self.fields:
            if f.name in seen:
                raise InvalidSchema(f"{self.name}: field {f.name!r} is declared twice")
            seen.add(f.name)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def key_queryable(self) -> bool:
        return self.transparent is False and (self.key_kind != "string" or self.string_key_index)

    @property
    def transparent(self) -> bool:
        """No indexed field and no string key index: records can be read and written but not queried."""
        return not any(f.index for f in self.fields) and not self.string_key_index

    def named(self, name: str) -> Field | None:
        """The field that a patch means by a name: its own, an alias or its JSON name."""
        own = self.field(name)
        if own:
            return own
        found = [f for f in self.fields if name in f.aliases or name == f.json]
        return found[0] if len(found) == 1 else None

    def with_index(self, index: Mapping[str, str]) -> Schema:
        """The schema with other index kinds; names are fields or aliases, all others lose theirs."""
        kinds: dict[str, str] = {}
        for name, kind in index.items():
            f = None if name == KEY else self.named(name)
            if f is None:
                raise InvalidSchema(f"{self.name}: no single field is called {name!r}")
            if f.name in kinds:
                raise InvalidSchema(f"{self.name}: {f.name!r} is given twice")
            kinds[f.name] = kind
        return replace(self, fields=tuple(replace(f, index=kinds.get(f.name)) for f in self.fields))

    @classmethod
    def of(cls, df: DataFrame, key: str, name: str = "records", measures: Iterable[str] = (), unique: Iterable[str] = (), unindexed: Iterable[str] = (), string_key_index: bool = False, uint64: Iterable[str] = ()) -> Schema:
        """A schema that follows a DataFrame: every field that can be is indexed, but for those named otherwise."""
        fields = []
        for f in df.schema.fields:
            if f.name == key:
                continue
            array = isinstance(f.dataType, T.ArrayType)
            kind = "uint64" if f.name in uint64 else _SPARK.get(type(f.dataType.elementType if array else f.dataType))
            if kind is None:
                raise InvalidSchema(f"{name}: {f.name} has the unsupported type {f.dataType.simpleString()}")
            index = "measure" if f.name in measures else "unique" if f.name in unique else None if f.name in unindexed or kind in OPAQUE else "index"
            fields.append(Field(f.name, kind, index, array, f.nullable, naive=isinstance(f.dataType, T.TimestampNTZType)))
        key_kind = "string" if isinstance(df.schema[key].dataType, T.StringType) else "int64"
        return cls(name, key, key_kind, tuple(fields), string_key_index)


def spark_type(f: Field) -> T.DataType:
    """The column type of a field."""
    if f.kind == "uint64":
        one: T.DataType = T.DecimalType(20, 0)
    elif f.kind == "time":
        one = T.TimestampNTZType() if f.naive else T.TimestampType()
    else:
        one = next(t for t, kind in _SPARK.items() if kind == f.kind)() if f.kind not in ("map", "struct") else T.MapType(T.StringType(), T.StringType())
    return T.ArrayType(one) if f.array else one
