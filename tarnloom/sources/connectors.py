"""Fetching sources: dispatch by scheme, an HTTP connector with its guards, and the Drive rules.

Connectors are injected functions from a URI to bytes and hints; they run inside
``mapInPandas`` on as many partitions as calls may run at once.
"""

from __future__ import annotations

import http.client
import json
import socket
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.uri import is_public

MOST_BYTES = 50 * 1024 * 1024
MOST_REDIRECTS = 5
TIMEOUT_SECONDS = 30
#: Fixed value: where Drive serves files.
DRIVE_FILES = "https://www.googleapis.com/drive/v3/files"
# Native Drive formats, what they are exported as, and the suffix of the export.
DRIVE_EXPORTS = {
    "application/vnd.google-apps.document": ("text/html", ".html"),
    "application/vnd.google-apps.presentation": ("text/plain", ".txt"),
}


class FetchError(RuntimeError):
    """A source that cannot be fetched; a retry may help."""


@dataclass
class Fetched:
    content: bytes
    filename: str
    content_type: str | None = None


def check_public(host: str) -> None:
    """Refuse a host if any of its addresses is not public."""
    try:
        found = {info[4][0] for info in socket.getaddrinfo(host, None, proto=socket.IPPROTO_TCP)}
    except socket.gaierror as e:
        raise FetchError(f"cannot resolve {host!r}") from e
    if bad := [a for a in sorted(found) if not is_public(a.split("%")[0])]:
        raise FetchError(f"{host!r} resolves to the non-public address {bad[0]}")


def response_filename(url: str, disposition: str | None) -> str:
    declared = (disposition or "").partition("filename=")[2].strip().strip('"; ')
    path = urllib.parse.unquote(urllib.parse.urlsplit(url).path)
    return urllib.parse.unquote(declared) or path.rstrip("/").rsplit("/", 1)[-1] or "document"


def fetch_http(url: str, allow_plain: bool = False, allow_private: bool = False, most_bytes: int = MOST_BYTES) -> Fetched:
    """GET with redirects followed by hand, so that every hop is checked, and a cap on the bytes read."""
    for _ in range(MOST_REDIRECTS + 1):
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise FetchError(f"not an HTTP address: {url}")
        if parts.scheme == "http" and not allow_plain:
            raise FetchError("plain http is not allowed")
        if not allow_private:
            check_public(parts.hostname)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        connection = kind(parts.hostname, parts.port, timeout=TIMEOUT_SECONDS)
        try:
            connection.request("GET", urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), headers={"User-Agent": "tarnloom"})
            response = connection.getresponse()
            if response.status in (301, 302, 303, 307, 308) and response.getheader("Location"):
                url = urllib.parse.urljoin(url, response.getheader("Location"))
                continue
            if response.status != 200:
                raise FetchError(f"{url} answered {response.status}")
            if (response.getheader("Content-Length") or "0").isdigit() and int(response.getheader("Content-Length") or 0) > most_bytes:
                raise FetchError(f"{url} is over {most_bytes} bytes")
            content = response.read(most_bytes + 1)
            if len(content) > most_bytes:
                raise FetchError(f"{url} is over {most_bytes} bytes")
            return Fetched(content, response_filename(url, response.getheader("Content-Disposition")), response.getheader("Content-Type"))
        except OSError as e:
            raise FetchError(f"{url}: {e}") from e
        finally:
            connection.close()
    raise FetchError(f"more than {MOST_REDIRECTS} redirects")


def drive_plan(name: str, mime: str) -> tuple[str, str, str | None]:
    """For a Drive file: ``export`` or ``download``, the file name, and the MIME type to export."""
    if mime in DRIVE_EXPORTS:
        target, suffix = DRIVE_EXPORTS[mime]
        return "export", name if name.endswith(suffix) else name + suffix, target
    if mime.startswith("application/vnd.google-apps."):
        raise FetchError(f"Drive files of type {mime} cannot be exported")
    return "download", name, None


class NotConfigured(RuntimeError):
    """A connector that lacks its credentials; a retry does not help."""


#: GET by address, query and headers, to status and body; reads one byte more than it may at most.
Get = Callable[[str, dict[str, str], dict[str, str]], tuple[int, bytes]]


def http_get(url: str, query: dict[str, str], headers: dict[str, str], most_bytes: int = MOST_BYTES) -> tuple[int, bytes]:
    parts = urllib.parse.urlsplit(url)
    connection = http.client.HTTPSConnection(parts.hostname, parts.port, timeout=TIMEOUT_SECONDS)
    try:
        connection.request("GET", f"{parts.path}?{urllib.parse.urlencode(query)}", headers=headers)
        response = connection.getresponse()
        return response.status, response.read(most_bytes + 1)
    except OSError as e:
        raise FetchError(f"{url}: {e}") from e
    finally:
        connection.close()


def drive_connector(token: Callable[[], str] | None, get: Get = http_get, most_bytes: int = MOST_BYTES) -> Callable[[str], Fetched]:
    """A connector for ``gdrive://<file id>``: the file's metadata, then its export or download."""

    def fetch(uri: str) -> Fetched:
        if token is None:
            raise NotConfigured("Drive needs a service account: pass a function that gives access tokens")
        file_id = urllib.parse.urlsplit(uri).netloc
        headers, address = {"Authorization": f"Bearer {token()}"}, f"{DRIVE_FILES}/{urllib.parse.quote(file_id, safe='')}"
        status, body = get(address, {"fields": "id,name,mimeType", "supportsAllDrives": "true"}, headers)
        if status == 404:
            raise FetchError(f"Drive file {file_id!r} is not there, or is not shared with the account")
        if status >= 400:
            raise FetchError(f"Drive answered {status} for the metadata of {file_id!r}")
        known = json.loads(body)
        how, name, export = drive_plan(known.get("name") or file_id, known.get("mimeType") or "")
        if how == "export":
            status, body = get(f"{address}/export", {"mimeType": export}, headers)
        else:
            status, body = get(address, {"alt": "media", "supportsAllDrives": "true"}, headers)
        if status >= 400:
            raise FetchError(f"Drive answered {status} for {file_id!r}")
        if len(body) > most_bytes:
            raise FetchError(f"{uri} is over {most_bytes} bytes")
        return Fetched(body, name, export or known.get("mimeType") or None)

    return fetch


CONNECTORS: dict[str, Callable[[str], Fetched]] = {"https": fetch_http, "http": fetch_http, "gdrive": drive_connector(None)}


def fetch_sources(sources: DataFrame, connectors: dict[str, Callable[[str], Fetched]] | None = None, concurrency: int = 8) -> DataFrame:
    """``sources(source, ...)`` with ``content, filename, content_type, fetch_error``.

    A scheme without a connector (``upload`` above all) is an error of its row, and so is a
    connector's exception; no row stops the others.
    """
    by_scheme = CONNECTORS if connectors is None else connectors
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields) + ", content binary, filename string, content_type string, fetch_error string"

    def one(uri: str) -> tuple:
        scheme = (uri or "").split(":", 1)[0].lower()
        if scheme not in by_scheme:
            return None, None, None, f"no connector for {scheme}://"
        try:
            got = by_scheme[scheme](uri)
            return got.content, got.filename, got.content_type, None
        except Exception as e:  # noqa: BLE001
            return None, None, None, f"{type(e).__name__}: {e}"[:2000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(u) for u in batch["source"]]
            yield batch.assign(**{c: [g[k] for g in got] for k, c in enumerate(("content", "filename", "content_type", "fetch_error"))})

    return sources.repartition(concurrency).mapInPandas(run, schema)
