"""Canonical columns shared by all sources."""

ARTICLES = (
    "article_id string, source string, feed_rank int, entry_index bigint, title string, "
    "link string, description string, published string, published_ts timestamp"
)
RAW_FEEDS = "value string, feed_rank int, fetch bigint"
FEED_ENTRY = (
    "position int, cut_off string, title string, link string, summary string, description string, "
    "published string, updated string"
)
