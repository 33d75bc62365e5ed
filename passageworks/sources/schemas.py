"""Declared schemas of the relational tables and of the chunk table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from passageworks.functions import fixed


@dataclass(frozen=True)
class TableSpec:
    """What a table promises beyond Spark's types; see `operators.quality`."""

    primary_key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    foreign_keys: tuple[str, ...] = ()
    vector_dims: dict[str, int] = field(default_factory=dict)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_INT, _LONG, _STR, _TS = T.IntegerType(), T.LongType(), T.StringType(), T.TimestampNTZType()

USERS = _struct(
    ("id", _INT, False),
    ("name", _STR, False),
    ("email", _STR, False),
    ("role", _STR, False),
    ("created_at", _TS, False),
)
TICKETS = _struct(
    ("id", _INT, False),
    ("user_id", _INT, False),
    ("title", _STR, False),
    ("status", _STR, False),
    ("priority", _STR, False),
    ("category", _STR, False),
    ("created_at", _TS, False),
    ("closed_at", _TS, True),
)
MESSAGES = _struct(
    ("id", _INT, False),
    ("ticket_id", _INT, False),
    ("sender_type", _STR, False),
    ("sender_name", _STR, False),
    ("body", _STR, False),
    ("created_at", _TS, False),
)
CHUNKS = _struct(
    ("id", _LONG, False),
    ("source_table", _STR, False),
    ("source_id", _LONG, True),
    ("content", _STR, False),
    ("embedding", T.ArrayType(T.FloatType(), False), False),
)

SPECS = {
    "users": TableSpec(
        primary_key=("id",),
        not_null=("name", "email", "role", "created_at"),
        max_length={"name": 100, "email": 150, "role": 50},
    ),
    "tickets": TableSpec(
        primary_key=("id",),
        not_null=("user_id", "title", "status", "priority", "category", "created_at"),
        max_length={"title": 200, "status": 50, "priority": 50, "category": 100},
        foreign_keys=("user_id",),
    ),
    "messages": TableSpec(
        primary_key=("id",),
        not_null=("ticket_id", "sender_type", "sender_name", "body", "created_at"),
        max_length={"sender_type": 50, "sender_name": 100},
        foreign_keys=("ticket_id",),
    ),
    "rag_chunks": TableSpec(
        primary_key=("id",),
        not_null=("source_table", "content", "embedding"),
        vector_dims={"embedding": fixed.EMBEDDING_DIM},
    ),
}
