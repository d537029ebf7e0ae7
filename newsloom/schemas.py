"""Table schemas shared by every job, as DDL text."""

HOWTO = """
rss struct<item_limit: int, date_field: string>,
html struct<list_selector: string, title_selector: string, date_selector: string, content_selector: string>,
js struct<list_selector: string, title_selector: string, date_selector: string, content_selector: string,
          wait_for: string, wait_ms: int, strategy: string, notes: string>,
api struct<items_path: string, url_field: string, title_field: string, date_field: string, content_field: string>
"""

#: One configured source. ``howto`` holds one filled section, the one named by ``type``.
SOURCES = f"source_id int, name string, url string, type string, howto struct<{HOWTO}>"

#: What a fetcher brought back for a url; ``rendered`` tells a browser capture from a plain one.
CAPTURES = "url string, fetched_at timestamp, ok boolean, rendered boolean, body string"

#: What a source offers, in listing order.
ITEMS = (
    "source_id int, pos int, url string, title string, published_date string, content string"
)

#: The curated table. ``url`` and ``title`` are each unique because ingest keeps them so.
NEWS = (
    "url string, title string, published_date string, published_ts timestamp, collected_at timestamp,"
    " ingest_seq bigint, content string, summary string, iso_year int, iso_week int"
)

REQUESTS = "request_id string, kind string, key string, instructions string, input string"
RESPONSES = "request_id string, output string, error string"
