"""The known report types."""

from __future__ import annotations

from collections.abc import Sequence

from panelloom.model import UnknownPackError
from panelloom.pack import ReportPack
from panelloom.packs import campaigns, inventory

PACKS: dict[str, ReportPack] = {p.key: p for p in (inventory.PACK, campaigns.PACK)}


def get_pack(key: str) -> ReportPack:
    try:
        return PACKS[key]
    except KeyError:
        raise UnknownPackError(f"no report type {key!r}", available=sorted(PACKS)) from None


def detect_pack(headers: Sequence[str]) -> ReportPack | None:
    """First pack all of whose required columns are among the headers."""
    for pack in PACKS.values():
        if not pack.match_headers(headers).missing:
            return pack
    return None
