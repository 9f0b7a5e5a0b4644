"""Helpers for writing the DuckDB oracle statements next to the Spark plans."""

from __future__ import annotations


def oracle(parts: list[str], select: str, doubles: list[str] = (), money: list[str] = (),
           money_places: int = 4) -> str:
    """``WITH <parts> <select>`` with the listed DOUBLE columns rounded to 6
    places (the same rounding the Spark side applies via ``round_doubles``);
    ``money`` columns (large totals of cent/basis-point inputs) to
    ``money_places``.  Sums of cents over quarter hours end in a 5 a few places
    down, where the two engines' rounding may part; 9 places lie below that."""
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    if not doubles and not money:
        return head + select
    # CAST: DuckDB types decimal literals as DECIMAL; the Spark side is DOUBLE
    rep = ", ".join([f"CAST(round({c}, 6) AS DOUBLE) + 0.0 AS {c}" for c in doubles if c not in money]
                    + [f"CAST(round({c}, {money_places}) AS DOUBLE) + 0.0 AS {c}" for c in money])
    return head + f"SELECT * REPLACE ({rep}) FROM (\n{select}\n) q"
