"""News capture analytics as Spark jobs: captured feeds, pages and payloads in, a curated news table and weekly digests out."""
