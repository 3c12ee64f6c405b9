"""Run parameters and fixed vocabularies shared by every operator."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

MONEY = "decimal(18,4)"

# Header synonyms per line-item field.
COLUMN_KEYS: dict[str, tuple[str, ...]] = {
    "description": (
        "description", "item", "details", "product", "service", "goods", "particulars", "desc",
        "name", "work", "task", "item description", "product description",
    ),
    "sku": (
        "sku", "code", "item code", "part no", "part number", "part#", "ref", "product code",
        "cat no", "cat#", "item no", "item #", "item number", "job code",
    ),
    "quantity": (
        "qty", "quantity", "units", "no", "hours", "hrs", "count", "no.", "qty.", "order",
        "ordered", "supply", "supplied", "order qty", "supply qty", "delivered", "invoiced",
    ),
    "unit": ("unit", "uom", "each", "measure", "unit of measure"),
    "unit_price": (
        "unit price", "unit_price", "rate", "price", "unitprice", "unit cost", "each", "cost",
        "per unit", "charge", "unit rate", "price each",
    ),
    "total": (
        "total", "amount", "line total", "linetotal", "ext", "extended", "net", "line amount",
        "nett", "extended amount", "total amount", "net amount",
    ),
}

# Order in which a header claims a still unassigned field.
FIELD_PRIORITY = ("description", "sku", "quantity", "unit", "unit_price", "total")

# Order of the scoring tests and their weights ("unit" never scores).
SCORE_WEIGHTS = (("description", 2), ("quantity", 1), ("unit_price", 1), ("total", 1), ("sku", 1))

# Review states.
NEEDS_REVIEW, READY, EXPORTED = "needs_review", "ready", "exported"
STATUSES = (NEEDS_REVIEW, READY, EXPORTED)


@dataclass(frozen=True)
class CustomField:
    """One operator-defined field; ``source`` is ``llm`` (automatic), ``text`` or ``lookup``."""

    name: str
    label: str = ""
    source: str = "llm"
    mandatory: bool = False
    hidden: bool = False
    regex: str | None = None
    table_keys: tuple[str, ...] = ()
    hint: str | None = None


@dataclass(frozen=True)
class Params:
    """Thresholds of one run. ``as_of`` pins "today" so that a rerun gives the same result."""

    as_of: dt.date = field(default_factory=dt.date.today)
    max_invoice_age_days: int = 90
    max_future_days: int = 7
    arithmetic_tolerance: str = "0.05"
    supplier_fuzzy_threshold: int = 75
    #: Where similar-name matches are kept between runs; None keeps none.
    match_cache: str | None = None
    use_anchoring: bool = True
    line_fuzzy_threshold: int = 65
    po_total_tolerance_pct: str = "0.01"
    price_tolerance_pct: str = "0.01"
    quantity_tolerance: str = "0.001"
    total_tolerance: str = "0.05"
    mandatory_fields: tuple[str, ...] = ("invoice_date", "invoice_number", "supplier.name", "total")
    hidden_fields: tuple[str, ...] = ("bill_to.contact", "supplier.website")
    custom_fields: tuple[CustomField, ...] = ()
    column_keys: dict[str, tuple[str, ...]] = field(default_factory=lambda: COLUMN_KEYS)
    min_table_score: int = 2
