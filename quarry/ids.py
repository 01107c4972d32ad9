"""Automatic keys."""

from __future__ import annotations

import os
import threading
import time

from .errors import SequenceExhausted

_lock, _last = threading.Lock(), [0]


def numbered(sequence: int, node: int = 0) -> int:
    """The key for a place in the sequence: the place itself, or 16 bits of node and 48 of sequence."""
    if not 0 <= node < 1 << 16:
        raise ValueError("a node is a number of 16 bits")
    if sequence >= 1 << (48 if node else 63):
        raise SequenceExhausted("no id is left")
    return node << 48 | sequence if node else sequence


def time_ordered() -> str:
    """A UUID of version 7: milliseconds, then random bits; those made by one process ascend."""
    with _lock:
        stamp = max(time.time_ns() >> 8, _last[0] + 1)  # steps of 256 ns give 12 more bits of order
        _last[0] = stamp
    ms, fraction = (stamp << 8) // 1_000_000, ((stamp << 8) % 1_000_000) * 4096 // 1_000_000
    value = (ms & (1 << 48) - 1) << 80 | 7 << 76 | fraction << 64 | 2 << 62 | int.from_bytes(os.urandom(8), "big") >> 2
    text = f"{value:032x}"
    return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))
