"""Filters on header maps: deny by default, with name lists and namespaces as data."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names that clients send and what is done with them
COMMON = ("accept", "accept-encoding", "accept-language", "content-type", "content-length", "user-agent")
PROVIDERS = {
    "openai": ("authorization", "openai-organization", "openai-project", "openai-beta", "chatgpt-account-id", "originator", "session-id", "thread-id", "x-openai-internal-codex-responses-lite"),
    "anthropic": ("authorization", "x-api-key", "anthropic-version", "anthropic-beta", "anthropic-dangerous-direct-browser-access", "x-claude-code-session-id", "x-claude-code-agent-id", "x-claude-code-parent-agent-id"),
}
NAMESPACES = {"openai": "x-codex-", "anthropic": "anthropic-"}
AUTH = ("authorization", "x-api-key")
TRANSPORT = (
    "host", "connection", "upgrade", "sec-websocket-key", "sec-websocket-version", "sec-websocket-extensions", "sec-websocket-protocol", "content-length", "accept-encoding",
    "accept", "accept-language", "user-agent", "x-claude-code-session-id", "x-claude-code-agent-id", "x-claude-code-parent-agent-id", "via", "forwarded", "x-forwarded-for",
    "x-forwarded-host", "x-forwarded-proto", "x-real-ip",
)


def _in_namespace(name: Column, provider: str) -> Column:
    return F.startswith(name, F.lit(NAMESPACES[provider])) if provider in NAMESPACES else F.lit(False)


def forwarded(headers: Column, provider: str) -> Column:
    """What may go to the provider; everything not named goes."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*COMMON, *PROVIDERS.get(provider, ())) | _in_namespace(F.lower(k), provider))


def scannable(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*AUTH, *TRANSPORT))


def free_text(headers: Column, provider: str) -> Column:
    """Scannable headers of the provider's namespace."""
    return F.map_filter(scannable(headers), lambda k, v: _in_namespace(F.lower(k), provider))


def handshake(headers: Column) -> tuple[Column, Column]:
    """Headers of a socket's handshake without those the transport makes, and the user agent."""
    sent = forwarded(headers, "openai")
    agent = F.map_values(F.map_filter(sent, lambda k, v: F.lower(k) == "user-agent"))
    return F.map_filter(sent, lambda k, v: ~F.lower(k).isin(*COMMON)), F.try_element_at(agent, F.lit(1))


def summary(headers: Column) -> Column:
    """For logs: authorisation is told as present only."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*AUTH), F.lit("[REDACTED]")).otherwise(v))


def upstream(url: str, official: str) -> str:
    """The address that requests go to, without a slash at its end: the official one or one of this machine, by http or
    https, without credentials, query and fragment; anything else is an error."""
    parts = urlsplit(url)
    parts.port  # noqa: B018  an error if it is no port
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise ValueError("the upstream address must be plain http or https")
    if url.rstrip("/") != official and parts.hostname not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError("the upstream address must be the official one or local")
    return url.rstrip("/")
