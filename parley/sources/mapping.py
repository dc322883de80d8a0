"""Canonical tables of a seller export and the mapping of foreign columns onto them.

Only column names are looked at here; nothing touches rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Required columns by table.
REQUIRED = {
    "listings": "listing_id event_time available_at asking_price_amount currency category listing_status",
    "offers": "offer_id listing_id event_time available_at offer_amount currency offer_state",
    "orders": "order_id listing_id event_time available_at sale_price_amount currency order_status",
    "fees": "fee_id order_id event_time available_at fee_amount currency fee_type",
    "shipping_costs": "shipping_id order_id event_time available_at shipping_cost_amount currency",
    "cost_basis": "cost_basis_id listing_id event_time available_at unit_cost_amount currency",
    "cancellations_unpaid": "cancellation_id event_time available_at event_type currency",
    "returns_refunds": "return_id order_id event_time available_at refund_amount currency",
    "inventory": "inventory_id listing_id event_time available_at quantity_available",
    "traffic": "traffic_id listing_id event_time available_at impressions views",
}

# Optional columns by table.
OPTIONAL = {
    "listings": "sku title condition listed_at ended_at quantity_listed",
    "offers": "buyer_id_hash seller_response seller_response_time seller_response_amount decision_history_available_at expires_at",
    "orders": "offer_id paid_at completed_at return_window_matured_at quantity",
    "fees": "listing_id",
    "shipping_costs": "listing_id carrier",
    "cost_basis": "sku cost_source",
    "cancellations_unpaid": "order_id listing_id offer_id amount",
    "returns_refunds": "listing_id return_opened_at return_closed_at return_window_matured_at return_status",
    "inventory": "sku inventory_age_days warehouse_location",
    "traffic": "period_start period_end watchers",
}

# Foreign spellings by table, lower case without punctuation.
SYNONYMS = {
    "listings": {"itemid": "listing_id", "price": "asking_price_amount", "askingprice": "asking_price_amount", "createdat": "event_time"},
    "offers": {
        "bestofferid": "offer_id", "itemid": "listing_id", "offerprice": "offer_amount", "amount": "offer_amount",
        "createdat": "event_time", "respondedat": "seller_response_time", "response": "seller_response",
    },
    "orders": {
        "transactionid": "order_id", "itemid": "listing_id", "bestofferid": "offer_id", "paidat": "paid_at",
        "soldprice": "sale_price_amount", "price": "sale_price_amount", "status": "order_status",
    },
    "fees": {"transactionid": "order_id", "amount": "fee_amount", "type": "fee_type"},
    "shipping_costs": {"transactionid": "order_id", "amount": "shipping_cost_amount", "cost": "shipping_cost_amount"},
    "cost_basis": {"itemid": "listing_id", "cost": "unit_cost_amount", "unitcost": "unit_cost_amount"},
    "cancellations_unpaid": {"transactionid": "order_id", "itemid": "listing_id"},
    "returns_refunds": {"transactionid": "order_id", "itemid": "listing_id", "amount": "refund_amount"},
    "inventory": {"itemid": "listing_id", "age": "inventory_age_days", "quantity": "quantity_available"},
    "traffic": {"itemid": "listing_id", "pageviews": "views", "viewcount": "views"},
}

# Columns by meaning.
MONEY = (
    "asking_price_amount offer_amount seller_response_amount sale_price_amount fee_amount shipping_cost_amount "
    "unit_cost_amount amount refund_amount"
).split()
WHOLE = "quantity_listed quantity quantity_available impressions views watchers".split()
TIMES = (
    "event_time available_at listed_at ended_at seller_response_time decision_history_available_at expires_at paid_at "
    "completed_at return_window_matured_at return_opened_at return_closed_at period_start period_end"
).split()
MATERIAL = {
    "orders": "sale_price_amount",
    "fees": "fee_amount",
    "shipping_costs": "shipping_cost_amount",
    "cost_basis": "unit_cost_amount",
    "returns_refunds": "refund_amount",
}

IGNORE = "ignore"


def canonical_columns(table: str) -> list[str]:
    return REQUIRED[table].split() + OPTIONAL[table].split()


def propose_mapping(columns: list[str], table: str) -> dict[str, str]:
    """Canonical target of every source column; ``ignore`` where none is known."""

    def bare(name: str) -> str:
        return "".join(ch for ch in name.casefold() if ch.isalnum())

    known = {**SYNONYMS[table], **{bare(name): name for name in canonical_columns(table)}}
    return {name: known.get(bare(name), IGNORE) for name in columns}


def validate_mapping(columns: list[str], table: str, mapping: dict[str, str]) -> dict[str, list[str]]:
    """What stands against a mapping; empty lists mean that it can be applied."""
    used = {s: t for s, t in mapping.items() if t != IGNORE}
    reached = [t for s, t in used.items() if s in columns]
    return {
        "unmapped": sorted(set(columns) - set(mapping)),
        "unknown_sources": sorted(set(mapping) - set(columns)),
        "invalid_targets": sorted(set(used.values()) - set(canonical_columns(table))),
        "duplicate_targets": sorted({t for t in reached if reached.count(t) > 1}),
        "missing_required": sorted(set(REQUIRED[table].split()) - set(reached)),
    }


def apply_mapping(df: DataFrame, table: str, mapping: dict[str, str]) -> DataFrame:
    """All canonical columns of the table; first source wins, absent ones are NULL text."""
    picks = []
    for target in canonical_columns(table):
        sources = [F.col(f"`{s}`").cast("string") for s in df.columns if mapping.get(s) == target]
        picks.append((F.coalesce(*sources) if sources else F.lit(None).cast("string")).alias(target))
    return df.select(*picks)
