"""Schemas of the engine's tables."""

from pyspark.sql import Column
from pyspark.sql import functions as F

POSTING = "source_id string, title string, company string, url string, location string, description string, ord long"
#: A captured response: kind is listing or detail; request_key is a search term, a page or an identifier.
PAYLOAD = "source_id string, request_key string, page int, kind string, url string, status int, body string, ord long"
COMPANY = "name string, url string, ats string, identifier string, identifier_workday struct<tenant:string,wd_host:string,site:string>, careers_url string, match_method string, resolved_at timestamp, ord long"
SOURCE = "id string, adapter string, url string, rss_url string, path string, ord long"

#: Bits of the parts of a posting's ord: its source or company, its response, its place in that.
RANK_BITS, REQUEST_BITS, PLACE_BITS = 20, 26, 16


def packed_ord(section: int, rank: Column, request: Column, place: Column) -> Column:
    """One long that sorts by section (0 boards, 1 companies), then by the parts; parts too large for it are an error."""
    fits = (rank < 1 << RANK_BITS) & (request < 1 << REQUEST_BITS) & (place < 1 << PLACE_BITS)
    both = F.shiftleft(rank.cast("long") + (section << RANK_BITS), REQUEST_BITS + PLACE_BITS) + F.shiftleft(request.cast("long"), PLACE_BITS) + place.cast("long")
    return F.when(fits, both).otherwise(F.raise_error(F.lit("ord has no room for this many sources, responses or rows")).cast("long"))
