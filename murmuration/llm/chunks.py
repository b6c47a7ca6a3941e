"""A memory of encoded words, bounded in bytes, kept by a Python worker from task to task."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Entries and bytes of one generation; two generations are held.
GENERATION = 300_000
BYTES = 64 << 20
#: Longer strings are encoded each time: in texts without spaces every text is a string of its own.
LONGEST = 64
#: What an entry takes beside its characters.
_ENTRY = 150


class Memory:
    """Remembers what `encode_new` gives for a string. Old entries go by generation, and are computed again if asked for."""

    def __init__(self, encode_new: Callable[[list], Iterable], size: int = GENERATION, most: int = BYTES):
        self.encode_new, self.size, self.most = encode_new, size, most
        self.young: dict = {}
        self.old: dict = {}
        self.bytes = 0
        self.passing: list = []

    def prepare(self, needed: set) -> None:
        """Afterwards every needed string is in the young generation, until the next call."""
        for s in self.passing:
            del self.young[s]
        self.passing = []
        if len(self.young) > self.size or self.bytes > self.most:
            self.old, self.young, self.bytes = self.young, {}, 0
        needed = needed.difference(self.young)
        # By lookups: an intersection with a dictionary would walk through all of it.
        held = list(filter(self.old.__contains__, needed)) if self.old else []
        if held:
            self._keep(held, list(map(self.old.__getitem__, held)))
            needed = needed.difference(held)
        if not needed:
            return
        unknown = list(needed)
        found = list(self.encode_new(unknown))
        if max(map(len, unknown)) > LONGEST:
            pairs = list(zip(unknown, found, strict=True))
            self.young.update((s, x) for s, x in pairs if len(s) > LONGEST)
            self.passing = [s for s in unknown if len(s) > LONGEST]
            unknown, found = [s for s, _ in pairs if len(s) <= LONGEST], [x for s, x in pairs if len(s) <= LONGEST]
        self._keep(unknown, found)

    def _keep(self, strings, found: list) -> None:
        self.young.update(zip(strings, found, strict=True))
        # Characters beyond Latin-1 take up to four bytes.
        self.bytes += _ENTRY * len(found) + 4 * sum(map(len, strings)) + (sum(map(len, found)) if found and isinstance(found[0], bytes) else 8 * len(found))
