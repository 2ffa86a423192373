"""Checks of settings and requests at the driver: hosts, addresses, bounds, tokens, and whose path wins."""

from __future__ import annotations

import hmac
import ipaddress
import os
from urllib.parse import urlsplit

#: Greatest settings. Fixed values.
MOST_INPUT_CHARS, MOST_THRESHOLD_TOKENS = 10_000_000, 100_000


def loopback(host: str) -> bool:
    """Whether a host, IPv6 with or without brackets, is this machine."""
    bare = host.strip()
    if bare.lower() == "localhost":
        return True
    if bare.startswith("[") and bare.endswith("]"):
        bare = bare[1:-1]
    try:
        return ipaddress.ip_address(bare).is_loopback
    except ValueError:
        return False


def local_url(url: str) -> str:
    """The address of a model server, which must be on this machine."""
    host = urlsplit(url).hostname
    if host not in ("localhost", "127.0.0.1", "::1"):
        raise ValueError(f"the model's address must be on localhost, not {host or 'without a host'}")
    return url


def bounded(max_input_chars: int, inference_threshold_tokens: int) -> None:
    if max_input_chars > MOST_INPUT_CHARS:
        raise ValueError(f"max_input_chars is more than {MOST_INPUT_CHARS}")
    if inference_threshold_tokens > MOST_THRESHOLD_TOKENS:
        raise ValueError(f"inference_threshold_tokens is more than {MOST_THRESHOLD_TOKENS}")


def same_token(given: str | None, expected: str | None) -> bool:
    """Compared in constant time; without an expected token everyone may pass."""
    return expected is None or hmac.compare_digest((given or "").encode(), expected.encode())


def rules_path(setting: str | None, variable: str = "TERSELY_RULES") -> str | None:
    """The variable wins over the setting; blank counts as unset."""
    return os.environ.get(variable, "").strip() or setting
