"""The 16 tables as data: columns, keys, references, rules and defaults.

Validators, appends and deletes read these specs, so a rule is stated once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ID = T.StringType()
TEXT = T.StringType()
INT = T.IntegerType()
MONEY = T.DecimalType(12, 2)
STAMP = T.TimestampNTZType()
DAY = T.DateType()


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = False
    length: int | None = None
    default: object = None


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    parent_column: str
    on_delete: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)
    optional: tuple[Column, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])


def _id(name: str) -> Column:
    return Column(name, ID)


def _text(name: str, length: int | None = None, nullable: bool = False, default: str | None = None) -> Column:
    return Column(name, TEXT, nullable, length, default)


def _cascade(column: str, parent: str, parent_column: str) -> Reference:
    return Reference(column, parent, parent_column, "cascade")


def _restrict(column: str, parent: str, parent_column: str) -> Reference:
    return Reference(column, parent, parent_column, "restrict")


# Names, lengths, defaults, allowed words and delete rules of the data model.
SEATING = ("Free Seating", "Reserved Seating")
DISCOUNT_TYPES = ("NOMINAL", "PERCENTAGE")
PAID, PENDING, CANCELLED = "LUNAS", "PENDING", "DIBATALKAN"

_SPECS = [
    Table(
        "user_account",
        (_id("user_id"), _text("username", 100), _text("password", 255)),
        key=("user_id",),
        unique=(("username",),),
    ),
    Table(
        "role",
        (_id("role_id"), _text("role_name", 50)),
        key=("role_id",),
        unique=(("role_name",),),
    ),
    Table(
        "account_role",
        (_id("role_id"), _id("user_id")),
        key=("role_id", "user_id"),
        unique=(("user_id",),),
        references=(
            _restrict("role_id", "role", "role_id"),
            _cascade("user_id", "user_account", "user_id"),
        ),
    ),
    Table(
        "customer",
        (_id("customer_id"), _text("full_name", 100), _text("phone_number", 20, True), _id("user_id")),
        key=("customer_id",),
        unique=(("user_id",),),
        references=(_cascade("user_id", "user_account", "user_id"),),
    ),
    Table(
        "organizer",
        (_id("organizer_id"), _text("organizer_name", 100), _text("contact_email", 100, True), _id("user_id")),
        key=("organizer_id",),
        unique=(("user_id",),),
        references=(_cascade("user_id", "user_account", "user_id"),),
    ),
    Table(
        "venue",
        (
            _id("venue_id"),
            _text("venue_name", 100),
            Column("capacity", INT, default=1),
            _text("address"),
            _text("city", 100),
            _text("jenis_seating", 20),
        ),
        key=("venue_id",),
        rules={
            "capacity_check": "capacity > 0",
            "jenis_seating_check": "jenis_seating IN ('Free Seating', 'Reserved Seating')",
        },
    ),
    Table(
        "seat",
        (
            _id("seat_id"),
            _text("section", 50),
            _text("seat_number", 10),
            _text("row_number", 10),
            _id("venue_id"),
        ),
        key=("seat_id",),
        references=(_cascade("venue_id", "venue", "venue_id"),),
    ),
    Table(
        "event",
        (
            _id("event_id"),
            Column("event_datetime", STAMP),
            _text("event_title", 200),
            _id("venue_id"),
            _id("organizer_id"),
        ),
        key=("event_id",),
        references=(
            _restrict("venue_id", "venue", "venue_id"),
            _restrict("organizer_id", "organizer", "organizer_id"),
        ),
    ),
    Table(
        "artist",
        (_id("artist_id"), _text("name", 100), _text("genre", 100, True)),
        key=("artist_id",),
    ),
    Table(
        "event_artist",
        (_id("event_id"), _id("artist_id"), _text("role", 100, True)),
        key=("event_id", "artist_id"),
        references=(
            _cascade("event_id", "event", "event_id"),
            _restrict("artist_id", "artist", "artist_id"),
        ),
    ),
    Table(
        "ticket_category",
        (
            _id("category_id"),
            _text("category_name", 50),
            Column("quota", INT, default=1),
            Column("price", MONEY, default=0),
            _id("tevent_id"),
        ),
        key=("category_id",),
        references=(_cascade("tevent_id", "event", "event_id"),),
        rules={"quota_check": "quota > 0", "price_check": "price >= 0"},
    ),
    Table(
        "order",
        (
            _id("order_id"),
            Column("order_date", STAMP),
            _text("payment_status", 20),
            Column("total_amount", MONEY, default=0),
            _id("customer_id"),
        ),
        key=("order_id",),
        references=(_restrict("customer_id", "customer", "customer_id"),),
        rules={"totalamount_check": "total_amount >= 0"},
    ),
    Table(
        "ticket",
        (_id("ticket_id"), _text("ticket_code", 100), _id("tcategory_id"), _id("torder_id")),
        key=("ticket_id",),
        unique=(("ticket_code",),),
        references=(
            _restrict("tcategory_id", "ticket_category", "category_id"),
            _restrict("torder_id", "order", "order_id"),
        ),
        optional=(_text("status", 20, True, "VALID"),),
    ),
    Table(
        "has_relationship",
        (_id("seat_id"), _id("ticket_id")),
        key=("seat_id", "ticket_id"),
        references=(
            _restrict("seat_id", "seat", "seat_id"),
            _cascade("ticket_id", "ticket", "ticket_id"),
        ),
    ),
    Table(
        "promotion",
        (
            _id("promotion_id"),
            _text("promo_code", 50),
            _text("discount_type", 20, default="NOMINAL"),
            Column("discount_value", MONEY, default=1),
            Column("start_date", DAY),
            Column("end_date", DAY),
            Column("usage_limit", INT, default=1),
        ),
        key=("promotion_id",),
        unique=(("promo_code",),),
        rules={
            "discounttype_check": "discount_type IN ('NOMINAL', 'PERCENTAGE')",
            "discountvalue_check": "discount_value > 0",
            "usagelimit_check": "usage_limit > 0",
        },
    ),
    Table(
        "order_promotion",
        (_id("order_promotion_id"), _id("promotion_id"), _id("order_id")),
        key=("order_promotion_id",),
        references=(
            _restrict("promotion_id", "promotion", "promotion_id"),
            _cascade("order_id", "order", "order_id"),
        ),
    ),
]

TABLES: dict[str, Table] = {spec.name: spec for spec in _SPECS}


def references_to(parent: str) -> list[tuple[Table, Reference]]:
    """Every reference that points at ``parent``, with the table that holds it."""
    return [(spec, ref) for spec in _SPECS for ref in spec.references if ref.parent == parent]
