"""Source URIs: building, parsing, naming, and the guard against private addresses."""

from __future__ import annotations

import ipaddress
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

# Schemes, and the longest URI that is accepted.
FETCHABLE_SCHEMES = ["gdrive", "http", "https"]
KNOWN_SCHEMES = [*FETCHABLE_SCHEMES, "upload"]
MOST_CHARACTERS = 1024
CONNECTORS = {"http": "http", "https": "http", "gdrive": "google-drive"}


@F.pandas_udf(T.StringType())
def percent_encoded(text: pd.Series) -> pd.Series:
    """Every character but letters, digits and ``_.-~`` as UTF-8 triplets."""
    return text.map(lambda s: s if s is None else urllib.parse.quote(s, safe=""))


@F.pandas_udf(T.StringType())
def percent_decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or "%" not in s else urllib.parse.unquote(s))


@F.pandas_udf(T.StringType())
def _fitted(name: pd.Series, budget: pd.Series) -> pd.Series:
    """Encoded name, cut by whole characters until it fits."""

    def one(s: str, most: int) -> str:
        pieces, used = [], 0
        for c in s:
            e = urllib.parse.quote(c, safe="")
            if used + len(e) > most:
                break
            pieces.append(e)
            used += len(e)
        return "".join(pieces)

    return pd.Series([one(s, int(b)) for s, b in zip(name, budget, strict=True)])


def upload_uri(user_id: Column, filename: Column) -> Column:
    """``upload://user/name``: the name percent-encoded, and cut where the URI would be too long."""
    given = strip(F.coalesce(filename, F.lit("")))
    name = F.when(given == "", F.lit("document")).otherwise(given)
    prefix = F.concat(F.lit("upload://"), user_id.cast("string"), F.lit("/"))
    return F.concat(prefix, _fitted(name, F.lit(MOST_CHARACTERS) - F.length(prefix)))


def parse_source_uri(raw: Column) -> Column:
    """``struct<uri, scheme, authority, raw_path, error>``; the error is null for a valid URI.

    The path is still percent-encoded (see :func:`percent_decoded`): decoding needs Python,
    and most plans do not need it.
    """
    uri = strip(F.coalesce(raw, F.lit("")))
    scheme = F.lower(F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+", "")
    error = (
        F.when(uri == "", "empty")
        .when(F.length(uri) > MOST_CHARACTERS, "too_long")
        .when(scheme == "", "no_scheme")
        .when(~scheme.isin(KNOWN_SCHEMES), "unknown_scheme")
        .when(authority == "", "no_authority")
        .when(scheme.isin("http", "https") & (path == ""), "no_path")
    )
    return F.struct(uri.alias("uri"), scheme.alias("scheme"), authority.alias("authority"), path.alias("raw_path"), error.alias("error"))


def is_fetchable(scheme: Column) -> Column:
    return scheme.isin(FETCHABLE_SCHEMES)


def connector(scheme: Column) -> Column:
    """Name of the connector that fetches a scheme; null for uploads, which cannot be fetched again."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in CONNECTORS.items() for x in kv)), scheme)


def display_name(path: Column, authority: Column) -> Column:
    """Last segment of the path, else the authority."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(last != "", last).otherwise(authority)


def filename_from_response(url: Column, disposition: Column) -> Column:
    """``filename=`` of the Content-Disposition header, else the URL's last segment, else ``document``; still percent-encoded."""
    declared = F.regexp_replace(F.substring_index(F.substring_index(disposition, "filename=", -1), "filename=", 1), "^[\\s\"; ]+|[\\s\"; ]+$", "")
    named = F.when(disposition.contains("filename=") & (declared != ""), declared)
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.coalesce(named, F.nullif(last, F.lit("")), F.lit("document"))


def is_public(address: str) -> bool:
    a = ipaddress.ip_address(address)
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified)


@F.pandas_udf(T.BooleanType())
def is_public_address(address: pd.Series) -> pd.Series:
    """Whether a literal IP address may be fetched from; null for what is no address."""

    def one(s: str | None) -> bool | None:
        try:
            return None if s is None else is_public(s)
        except ValueError:
            return None

    return address.map(one)
