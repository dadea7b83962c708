"""HTTP sources: guard, retries, url and payload building; responses and errors as rows."""

from __future__ import annotations

import ipaddress
import json
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retried states, hosts never asked, the application's name in payloads, endings of internal hosts.
RETRIED = {429, 500, 502, 503, 504}
BLOCKED_HOSTS = {"localhost", "metadata.google.internal", "169.254.169.254", "0.0.0.0"}
APPLICATION_KEY = "olympusApplication"
BLOCKED_ENDINGS = (".local", ".internal", ".localhost")


class UnsafeUrl(ValueError):
    """The url may not be fetched."""


def check_url(url: str, allowed: Sequence[str] | None = None, https_only: bool = True, resolve: Callable[[str], list[str]] | None = None) -> str:
    """The url itself, or UnsafeUrl: https only, no blocked, internal or private hosts, listed domains and their subdomains only.

    ``resolve`` gives a name's addresses, which are then judged as well.
    """
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower().rstrip(".")
    except ValueError as e:
        raise UnsafeUrl(str(e)) from e
    if parts.scheme not in (("https",) if https_only else ("http", "https")):
        raise UnsafeUrl(f"scheme {parts.scheme!r} is not allowed")
    if not host or host in BLOCKED_HOSTS or host.endswith(BLOCKED_ENDINGS):
        raise UnsafeUrl(f"host {host!r} is blocked")
    if allowed and not any(host == d or host.endswith(f".{d}") for d in map(str.lower, allowed)):
        raise UnsafeUrl(f"host {host!r} is not in the list")
    try:
        addresses = [str(ipaddress.ip_address(host))]
    except ValueError:
        addresses = resolve(host) if resolve else []
    for a in map(ipaddress.ip_address, addresses):
        if a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast:
            raise UnsafeUrl(f"address {a} is private")
    return url


def system_resolver(host: str) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})


class GuardedRedirects(urllib.request.HTTPRedirectHandler):
    """Follows a redirect only where the first request might have gone."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        return super().redirect_request(req, fp, code, msg, headers, check_url(newurl, resolve=system_resolver))


def opener(url: str, method: str, body: bytes | None, headers: Mapping[str, str], timeout: float) -> tuple[int, str]:
    """Sends one request; the addresses of its host, and of each redirect's, are judged first."""
    check_url(url, resolve=system_resolver)
    request = urllib.request.Request(url, data=body, method=method, headers=dict(headers))
    try:
        with urllib.request.build_opener(GuardedRedirects).open(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def fetch(
    url: str, method: str = "GET", payload: object | None = None, headers: Mapping[str, str] | None = None, retries: int = 3, backoff: float = 1.0,
    timeout: float = 30.0, send: Callable[..., tuple[int, str]] = opener, sleep: Callable[[float], None] = time.sleep, guard: Callable[[str], str] = check_url,
) -> tuple[int, str]:
    """(status, body); retried states are tried again with doubling waits; 504 for a timeout, 502 for no connection, else 500.

    A url that ``guard`` refuses is never sent and gives 403.
    """
    try:
        guard(url)
    except UnsafeUrl as e:
        return 403, str(e)
    body = None if payload is None else json.dumps(payload).encode()
    heads = {"Content-Type": "application/json", **(headers or {})}
    answer = 500, ""
    for k in range(retries + 1):
        try:
            answer = send(url, method, body, heads, timeout)
        except TimeoutError:
            answer = 504, "timeout"
        except UnsafeUrl as e:
            return 403, str(e)
        except (ConnectionError, urllib.error.URLError) as e:
            answer = (504, "timeout") if isinstance(getattr(e, "reason", None), TimeoutError) else (502, "connection failed")
        except Exception as e:  # noqa: BLE001
            return 500, str(e)
        if answer[0] not in RETRIED or k == retries:
            return answer
        sleep(backoff * 2**k)
    return answer


def fetch_rows(requests: DataFrame, send: Callable[..., tuple[int, str]] = opener, **options) -> DataFrame:
    """(url, status, body, error) of each row of ``requests`` (url, method, payload), fetched in the executors."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [fetch(u, m or "GET", json.loads(p) if p else None, send=send, **options) for u, m, p in zip(f.url, f.method, f.payload, strict=True)]
            yield pd.DataFrame({"url": f.url, "status": [s for s, _ in got], "body": [b if s < 400 else None for s, b in got], "error": [None if s < 400 else b for s, b in got]})

    return requests.select("url", "method", "payload").mapInPandas(rows, "url string, status int, body string, error string")


def metadata_url(base: Column, regulation: Column, mapper: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), regulation, F.lit("metadata-service/metadata"), mapper)


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def valid_id(c: Column, known: Sequence[str]) -> Column:
    return clean(c).isin([k.lower() for k in known])


def payload_filter(branch: Column, window_type: Column, application: Column, files: Column | None = None, application_key: str = APPLICATION_KEY) -> Column:
    """JSON body that asks for a branch, a type and an application (named ``application_key``), and for files when there are any."""
    base = [branch.alias("winkeys:currBranch"), window_type.alias("winkeys:windowType"), application.alias(f"winkeys:{application_key}")]
    plain = F.to_json(F.struct(*base))
    return plain if files is None else F.when(F.size(files) > 0, F.to_json(F.struct(*base, files.alias("windata:a6")))).otherwise(plain)


def apply_payload_filter(facts: DataFrame, branch: str, window_type: str, application: str, files: Sequence[str] = ()) -> DataFrame:
    """The same filter on rows: branch, type and application equal, file among ``files`` when given."""
    out = facts.where((F.col("branch") == branch) & (F.col("window_type") == window_type) & (F.col("application") == application))
    return out.where(F.col("file").isin(list(files))) if files else out
