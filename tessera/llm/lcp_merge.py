"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import zstandard

_HEAD = struct.Struct("<HHHqiHH")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes need no look."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (x.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - m :], "little") ^ int.from_bytes(b[len(b) - m :], "little")
    return m - (x.bit_length() + 7) // 8


def front_code(entries: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """Entries (string, left context, row, position, least, most), sorted by string: each string without what it shares with the one before."""
    out, last = [], b""
    for string, left, row, pos, least, most in entries:
        lcp = common_prefix(last, string)
        out += (_HEAD.pack(lcp, len(string) - lcp, len(left), row, pos, least, most), string[lcp:], left)
        last = string
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(string, common prefix with the one before in the run, the rest of the entry)."""
    raw, at, last = zstandard.ZstdDecompressor().decompress(blob), 0, b""
    while at < len(raw):
        lcp, tail, left, row, pos, least, most = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        last = last[:lcp] + raw[at : at + tail]
        at += tail
        yield last, lcp, (raw[at : at + left], row, pos, least, most)
        at += left


def merged(runs: list[bytes]) -> Iterator[tuple[bytes, int, tuple]]:
    """All entries of the runs in order, each with its common prefix with the entry before.

    A tree of losers over the heads of the runs. Every head carries its common prefix with the string given out last; of two
    heads the one with the longer prefix is the smaller, and only equal prefixes are compared, from there on.
    """
    heads = [decoded(r) for r in runs]
    k = len(heads)
    strings: list[bytes | None] = [None] * k
    prefix, rest = [0] * k, [None] * k
    for i in range(k):
        if (x := next(heads[i], None)) is not None:
            strings[i], rest[i] = x[0], x[2]

    def beats(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes its common prefix with the winner."""
        a, b = strings[i], strings[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if prefix[i] != prefix[j]:
            return (i, j) if prefix[i] > prefix[j] else (j, i)
        p = common_prefix(a, b, prefix[i])
        win, lose = (i, j) if a[p:] < b[p:] or (a == b and i < j) else (j, i)
        prefix[lose] = p
        return win, lose

    if not k:
        return
    losers = [0] * k  # losers[0] is the winner of all
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = beats(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while strings[top] is not None:
        yield strings[top], prefix[top], rest[top]
        if (x := next(heads[top], None)) is None:
            strings[top] = None
        else:
            strings[top], prefix[top], rest[top] = x
        node = (top + k) // 2
        while node:
            top, losers[node] = beats(top, losers[node])
            node //= 2
