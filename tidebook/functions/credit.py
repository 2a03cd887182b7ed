"""The queue-credit setting: how much of a level's cancelled quantity moves orders up, from 0 to 1."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

#: Names that older runs used for the two ends.
LEGACY = {"none": Decimal("0.0"), "proportional": Decimal("1.0")}


def parse_credit(value: object) -> Decimal:
    """A credit in [0, 1]; zero in any spelling is 0."""
    try:
        credit = Decimal(str(value))
    except InvalidOperation:
        credit = Decimal("NaN")
    if not (credit.is_finite() and 0 <= credit <= 1):
        raise ValueError("queue credit must lie in [0, 1]")
    return credit or Decimal(0)


def from_legacy(name: str) -> Decimal:
    if name not in LEGACY:
        raise ValueError(f"queue mode must be one of {', '.join(LEGACY)}")
    return LEGACY[name]


def to_legacy(value: object) -> str | None:
    """The older name, which only the ends have."""
    return {credit: name for name, credit in LEGACY.items()}.get(parse_credit(value))


def suffix(value: object) -> str:
    """What an artifact's name ends with; full credit is the default and has nothing."""
    credit = parse_credit(value)
    return "" if credit == 1 else f"_qc{credit.normalize()}"
