"""Tables of PDF collections."""

from .collection import Pdfs, freed, latest, listing, operator_groups

__all__ = ["Pdfs", "freed", "latest", "listing", "operator_groups"]
