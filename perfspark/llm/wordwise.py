"""Token ids of many texts at once, by their distinct words.

Where a tokenizer never lets a token reach across the start of a word, a text is
the concatenation of its words' ids.  A batch of texts is split into words by
Arrow and its words are numbered there; Python sees each distinct word once, looks
it up in a bounded memory, and has the unknown ones encoded together.  The ids
of all texts are then gathered by numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest key that is remembered.
LONGEST = 64
#: In place of the ids of a word that has none.
NO_ID = 0xFFFFFFFF


#: Characters of unknown words that are encoded as one text.
JOINED = 1 << 16


def joined_ids(units: list[str], encode, length: np.ndarray) -> list[bytes | None]:
    """Ids of units, many of them as one text.  ``encode`` gives the ids of a
    text, ``length`` the bytes that an id stands for; None for units whose ids
    do not end where the units end."""
    out: list[bytes | None] = []
    at = 0
    while at < len(units):
        to, chars = at, 0
        while to < len(units) and (to == at or chars + len(units[to]) <= JOINED):
            chars += len(units[to])
            to += 1
        some = units[at:to]
        ids = np.array(encode("".join(some)), np.uint32)
        told = np.cumsum(length[ids])
        wanted = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")) for u in some), np.int64, to - at))
        stop = np.searchsorted(told, wanted)
        fits = np.append(told, -1)[stop] == wanted
        stop, raw = 4 * (stop + 1), ids.tobytes()
        begin = np.append(0, stop[:-1])
        fits &= np.append(True, fits[:-1])
        out += [raw[b:e] if ok else None for b, e, ok in zip(begin.tolist(), stop.tolist(), fits.tolist())]
        at = to
    return out


class Remembered:
    """What ``fresh`` makes of lists of keys (strings or bytes), in a bounded
    memory: what is not used while half of it fills up is forgotten."""

    def __init__(self, fresh, size: int):
        self.fresh, self.size = fresh, max(size // 2, 1)
        self.known: dict = {}
        self.old: dict = {}

    def lookup(self, keys: list) -> list:
        """Values of distinct keys."""
        if len(self.known) >= self.size:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        values = list(map(known.get, keys))
        places = [i for i, v in enumerate(values) if v is None]
        if old:
            for i in places:
                value = old.get(keys[i])
                if value is not None:
                    values[i] = known[keys[i]] = value
            places = [i for i in places if values[i] is None]
        if places:
            new = [keys[i] for i in places]
            for i, key, value in zip(places, new, self.fresh(new)):
                values[i] = value
                if len(key) <= LONGEST:
                    known[key] = value
        return values


class Wordwise:
    """``fresh`` gives the ids (unsigned 32-bit, as bytes) of a list of units, a
    unit being a space and what follows up to the next word; a text is read as
    if a space stood before it.  Texts that match the RE2 pattern ``odd`` are not
    split at every space, but into what ``units`` says."""

    def __init__(self, fresh, odd: str, units, remembered: int):
        self.known, self.odd, self.units = Remembered(fresh, remembered), odd, units

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every text end, and all ids.  All texts are held at
        once, with their words."""
        none = np.zeros(0, np.int64)
        if not len(texts):
            return none, none.astype(np.uint32)
        odd = pc.match_substring_regex(texts, self.odd)
        plain = pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts
        words = pc.split_pattern(plain, " ")
        offsets = words.offsets.to_numpy()
        offsets = offsets - offsets[0]
        numbered = words.flatten().dictionary_encode()
        code = numbered.indices.to_numpy().astype(np.int64)
        units = [" " + w for w in numbered.dictionary.to_pylist()]
        further: dict[str, int] = {}

        def coded(unit: str) -> int:
            i = further.setdefault(unit, len(units))
            if i == len(units):
                units.append(unit)
            return i

        n_words = np.diff(offsets)
        if pc.any(odd).as_py():
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            parts, at = [], 0
            for row, text in zip(rows, texts.filter(odd).to_pylist()):
                own = np.array([coded(u) for u in self.units(text)], np.int64)
                parts += [code[at:offsets[row]], own]
                at, n_words[row] = offsets[row + 1], len(own)
            code = np.concatenate([*parts, code[at:]])
        values = self.known.lookup(units)
        table = np.frombuffer(b"".join(values), np.uint32)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin = np.cumsum(size) - size
        each = size[code]
        stop = np.cumsum(each)
        place = np.repeat((begin[code] - (stop - each)).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        ids = table[place]
        return np.append(0, stop)[np.cumsum(n_words)], ids
