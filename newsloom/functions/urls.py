"""URL expressions. They stay inside the JVM, so that filters on them are pushed below joins and UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let_sql, nested_let

# The generic URL syntax of RFC 3986, and the schemes that have an authority or relative references.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
WITH_AUTHORITY = (
    "^(?:ftp|http|gopher|nntp|telnet|imap|wais|file|mms|https|shttp|snews|prospero|rtsp|rtsps|rtspu|rsync|svn"
    "|svn[+]ssh|sftp|nfs|git|git[+]ssh|ws|wss|itms-services)$"
)
WITH_RELATIVE = (
    "^(?:|ftp|http|gopher|nntp|imap|wais|file|https|shttp|mms|prospero|rtsp|rtsps|rtspu|sftp|svn|svn[+]ssh|ws|wss)$"
)
IP_HOST = r"^[^\[\]]*\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\[\]]*)?|[vV][0-9A-Fa-f]+\..+)\].*$"


# A URL put together from its parts, ``u`` being struct<scheme, authority, path, query, fragment>.
ASSEMBLED = f"""concat(
  if(u.scheme <> '', u.scheme || ':', ''),
  if(u.authority <> '' OR startswith(u.path, '//')
     OR (u.scheme RLIKE r'{WITH_AUTHORITY}' AND (u.path = '' OR startswith(u.path, '/'))), '//', ''),
  u.authority,
  if(u.authority <> '' AND u.path <> '' AND NOT startswith(u.path, '/'), '/', ''),
  u.path,
  if(u.query <> '', '?' || u.query, ''),
  if(u.fragment <> '', '#' || u.fragment, ''))"""


def _parts(url: Column) -> Column:
    """``[scheme, authority, path, query, fragment]``, missing parts empty.

    Leading blanks and control characters, and line breaks anywhere, are no part of a URL; so a line break can stand
    between the parts.
    """
    clean = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    return F.split(F.regexp_replace(clean, SPLIT, "$1\n$2\n$3\n$4\n$5"), "\n")


def _assembled(scheme: str, authority: str, path: str, query: str = "''", fragment: str = "''") -> str:
    parts = f"named_struct('scheme', {scheme}, 'authority', {authority}, 'path', {path}, 'query', {query}, 'fragment', {fragment})"
    return nested_let(parts, f"u -> {ASSEMBLED}")


def normalize_url(url: Column) -> Column:
    """Comparison form: lower-case scheme and host, no query or fragment, one trailing slash dropped."""
    path = r"if(v.p[2] IN ('', '/'), '/', regexp_replace(v.p[2], r'/\z', ''))"
    whole = _assembled("lower(v.p[0])", "lower(v.p[1])", path)
    broken = rf"v.p[1] RLIKE r'[\[\]]' AND NOT v.p[1] RLIKE r'{IP_HOST}'"
    return let_sql(F.struct(url.alias("url"), _parts(url).alias("p")), f"v -> if({broken}, v.url, {whole})")


def is_same_url(candidate: Column, normalized: Column) -> Column:
    return normalize_url(candidate) == normalized


# ``.`` and ``..`` in a path ``t`` resolved; the closing segment of a directory is empty.
RESOLVED = r"""if(t RLIKE r'(^|/)\.\.?(/|\z)', aggregate(
  split(t, '/'),
  CAST(array() AS ARRAY<STRING>),
  (done, part) -> CASE WHEN part = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) WHEN part = '.' THEN done ELSE array_append(done, part) END,
  done -> array_join(if(t RLIKE r'(^|/)\.\.?\z', array_append(done, ''), done), '/')), t)"""


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``. A relative path loses empty segments, but for the last."""
    scheme = "lower(if(v.h[0] = '', v.b[0], v.h[0]))"
    merged = r"if(startswith(v.h[2], '/'), v.h[2], regexp_replace(regexp_replace(v.b[2], r'[^/]*\z', '') || v.h[2], '/{2,}', '/'))"
    resolved = nested_let(merged, f"t -> coalesce(nullif({RESOLVED}, ''), '/')")
    whole = _assembled(
        scheme,
        "if(v.h[1] <> '', v.h[1], v.b[1])",
        f"CASE WHEN v.h[1] <> '' THEN v.h[2] WHEN v.h[2] = '' THEN v.b[2] ELSE {resolved} END",
        "if(v.h[1] <> '' OR v.h[2] <> '' OR v.h[3] <> '', v.h[3], v.b[3])",
        "v.h[4]",
    )
    foreign = f"v.base = '' OR {scheme} <> lower(v.b[0]) OR NOT {scheme} RLIKE r'{WITH_RELATIVE}'"
    value = F.struct(base.alias("base"), href.alias("href"), _parts(base).alias("b"), _parts(href).alias("h"))
    return let_sql(value, f"v -> CASE WHEN v.href = '' THEN v.base WHEN {foreign} THEN v.href ELSE {whole} END")


def site_name(url: Column) -> Column:
    """A name for a source that has none: its url without scheme and outer slashes."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.regexp_replace(bare, r"^/+|/+$", "")
