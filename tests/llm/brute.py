"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def az_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def simhash(text: str | None, k: int = 3) -> int:
    words = re.findall(SPACE, az_lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(fps: dict[int, int], distance: int = 2) -> dict[int, int]:
    """Smallest id reachable, for every id."""
    parent = {i: i for i in fps}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
