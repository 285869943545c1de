"""Settings of a search."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    """``compat`` gives the literal results of older installations where they differ from the intended ones:
    escaped symbols in ``chars``, undecoded entities in pdf2xml text, and per-page matches that accumulate over the
    pages of a word index. ``split_items`` numbers the hits of one query in one item in many tasks, for items with tens of
    millions of hits; counting them first means that zones are matched twice."""

    min_query_length: int = 3
    search_media_values: bool = True
    xml_image_match: str = "order"
    xml_fix_mode: str = "no"
    compat: bool = False
    all_pages: bool = False
    split_items: bool = False
    base_url: str = "https://example.org/iiif"
    search_url: str = "https://example.org/search"

    def __post_init__(self) -> None:
        if self.xml_image_match not in ("order", "basename"):
            raise ValueError(f"xml_image_match: {self.xml_image_match!r}")
        if self.xml_fix_mode not in ("no", "dom", "regex", "all"):
            raise ValueError(f"xml_fix_mode: {self.xml_fix_mode!r}")

    @property
    def shortest(self) -> int:
        """The least length of a query and of a term; unset or 0 means 3."""
        return self.min_query_length or 3
