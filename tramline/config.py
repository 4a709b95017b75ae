"""Sources and the networks they should describe."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class NetworkShape:
    """Counts that a canonical table must show."""

    n_lines: int
    n_stations: int
    n_pairs: int


@dataclass(frozen=True)
class OperatorSource:
    """Where one operator's ridership is published."""

    name: str
    dataset_id: str
    resource_name: str
    network: NetworkShape


#: The published dataset of the one operator that has daily station counts.
OPERATORS = {
    "metro": OperatorSource("metro", "afluencia-diaria-del-metro-cdmx", "Afluencia diaria del Metro (simple)", NetworkShape(12, 163, 195)),
}
