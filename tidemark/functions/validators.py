"""Identifiers, risk scores and yes/no rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def _expanded(code: Column) -> Column:
    """Digits, letters as 10 to 35."""
    digit = lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)
    return F.array_join(F.transform(F.split(code, ""), digit), "")


def validate_lei(code: Column) -> Column:
    """Twenty of 0-9A-Z whose expansion leaves 1 modulo 97."""
    rest = F.aggregate(F.split(_expanded(code), ""), F.lit(0), lambda r, d: (r * 10 + d.try_cast("int")) % 97)
    return F.coalesce(F.when(code.rlike("^[0-9A-Z]{20}$"), rest == 1), F.lit(False))


def validate_isin(code: Column) -> Column:
    """Two letters and ten of 0-9A-Z that pass Luhn when expanded."""
    return F.coalesce(F.when(code.rlike("^[A-Z]{2}[0-9A-Z]{10}$"), F.luhn_check(_expanded(code)) if hasattr(F, "luhn_check") else F.call_function("luhn_check", _expanded(code))), F.lit(False))


def validate_mic(code: Column) -> Column:
    return F.coalesce(code.rlike("^[A-Z]{4}$"), F.lit(False))


def pre_trade_check(price: Column, reference: Column, notional: Column, daily: Column, collar_pct: float, max_order: float, max_daily: float, orders_in_window: Column | None = None, max_orders: int | None = None, banned: Column | None = None) -> Column:
    """The first rule that fails, else PASS; ``daily`` is the day's notional before the order.

    A message-rate limit throttles and a ban rejects, where given.
    """
    out = F.when(F.coalesce(banned, F.lit(False)), F.lit("INSTRUMENT_BANNED")) if banned is not None else F.when(F.lit(False), F.lit(""))
    out = (
        out.when((reference > 0) & (100.0 * F.abs(price - reference) / reference > collar_pct), F.lit("PRICE_COLLAR"))
        .when(notional > max_order, F.lit("MAX_ORDER_SIZE"))
        .when(daily + notional > max_daily, F.lit("MAX_DAILY_VOLUME"))
    )
    if orders_in_window is not None and max_orders is not None:
        out = out.when(orders_in_window > max_orders, F.lit("MAX_MESSAGE_RATE"))
    return out.otherwise(F.lit("PASS"))


#: Data classes: 0 public, 1 internal, 2 personal, 3 sensitive.
def requires_encryption(data_class: Column) -> Column:
    return data_class.isin(2, 3)


requires_pseudonymisation = requires_encryption


def meets_rpo(now_ns: Column, last_ns: Column, rpo_seconds: Column) -> Column:
    return F.floor((now_ns - last_ns) / F.lit(1_000_000_000)) <= rpo_seconds


def needs_rotation(state: Column, expiry_ns: Column, now_ns: Column) -> Column:
    return (state == "ACTIVE") & (expiry_ns != 0) & (now_ns >= expiry_ns)


def is_expired(created_ns: Column, now_ns: Column, days: Column, legal_hold: Column) -> Column:
    """Older than so many days; never under a legal hold."""
    return ~legal_hold & (now_ns - created_ns > days.cast("long") * F.lit(DAY_NS))


def is_drifted(psi: Column, threshold: float = 0.25) -> Column:
    return psi > threshold


def has_gaps(n_gaps: Column, actual: Column, expected: Column) -> Column:
    return (n_gaps > 0) | (actual < expected)


def dread_composite(dread: Column) -> Column:
    return sum((dread[k] for k in ("reproducibility", "exploitability", "affected_users", "discoverability")), dread["damage"]) / 5.0


def dread_valid(dread: Column) -> Column:
    ok = F.lit(True)
    for k in ("damage", "reproducibility", "exploitability", "affected_users", "discoverability"):
        ok = ok & dread[k].between(1, 10)
    return ok


def dread_severity(composite: Column) -> Column:
    return F.when(composite >= 9, "CRITICAL").when(composite >= 7, "HIGH").when(composite >= 4, "MEDIUM").otherwise("LOW")


def validate_handling(rule_class: Column, needs_encryption: Column, needs_pseudonyms: Column, purposes: Column, encrypted: Column, pseudonymised: Column, purpose: Column) -> Column:
    """The first handling rule that fails, else OK; an empty list of purposes allows all."""
    return (
        F.when(needs_encryption & ~encrypted, F.lit("ENCRYPTION_REQUIRED"))
        .when(needs_pseudonyms & ~pseudonymised, F.lit("PSEUDONYMISATION_REQUIRED"))
        .when((F.size(purposes) > 0) & ~F.array_contains(purposes, purpose), F.lit("PURPOSE_NOT_ALLOWED"))
        .otherwise(F.lit("OK"))
    )


def clock_in_sync(offset_ns: Column, standard: str = "general") -> Column:
    """Largest clock offset: 100 microseconds for high-frequency trading, a millisecond otherwise."""
    return F.abs(offset_ns) <= (100_000 if standard == "high_frequency" else 1_000_000)
