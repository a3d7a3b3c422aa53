"""Table and stream sources, and journals."""

from tidefold.sources.journal import Journal, JournalStore, Slots, Reader
from tidefold.sources.tables import Feed, load, stream

__all__ = ["Feed", "Journal", "JournalStore", "Slots", "Reader", "load", "stream"]
