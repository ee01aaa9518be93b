"""Token ids of whole texts.

A text is cut where its tokenizer cuts it in any case (between a non-space and a space). The
tokenizers library encodes each distinct piece once, and its ids are kept in sorted arrays under a
64-bit hash of the piece's bytes. The ids of a text are those of its pieces in order, equal to
encoding the text in one go. Python loops over missing pieces only; all else is done on arrays. A text
that holds the string of a special token is encoded whole, since the library gives such a string its
own id (where `special_as_text` is set, it is ordinary text).
"""

import os

import numpy as np

from .common import ranges, row_slices

# Unicode's White_Space, ASCII bytes and then longer characters in UTF-8.
WHITE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
WHITE_LONG = "\x85\xa0                　"

#: The longest piece whose ids are kept; longer ones are encoded whenever they are met.
LONGEST = 4096
LETTERS, STOPS = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"))
#: Letters below this one are composed, and have a lower case of one letter.
LATIN = "\u0130"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def white(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    ascii_table = np.zeros(256, bool)
    ascii_table[list(WHITE_BYTES)] = True
    out = ascii_table[raw]
    longs = {c.encode() for c in WHITE_LONG}
    leads = np.zeros(256, bool)
    leads[[c[0] for c in longs]] = True
    for i in np.flatnonzero(leads[raw]).tolist() if leads[raw].any() else ():
        for n in (2, 3):
            if raw[i : i + n].tobytes() in longs:
                out[i : i + n] = True
    return out


class PieceEncoder:
    """kind "byte": the white space before a word belongs to its piece; "word": white space is dropped."""

    def __init__(self, path: str, kind: str, keep: int = 1_500_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.alone = Tokenizer.from_file(path)
        self.alone.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content.encode() for t in self.alone.get_added_tokens_decoder().values()]
        self.alone.model._resize_cache(0)
        self.letters = byte_letters()
        self.kind, self.keep = kind, keep
        self.weights = np.random.default_rng(2024).integers(0, 2**63, LONGEST + 1, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.levels = [(none.astype(np.uint64), none, none)] * 2  # hash, first id's place, number of ids; the second is small
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and length of each piece, and the row that it is from."""
        space = white(raw)
        before = np.concatenate(([True], space[:-1]))
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        if len(raw):
            first[1:-1] |= LETTERS[raw[:-1]] & STOPS[raw[1:]]  # a stop after a letter begins a word to both tokenizers
        if self.kind == "byte":
            at = np.flatnonzero(first[:-1] | space & ~before)
            size = np.diff(np.append(at, len(raw)))
        else:
            at = np.flatnonzero(~space & (before | first[:-1]))
            stop = np.flatnonzero(~space & np.append(space[1:] | first[1:-1], True)) + 1
            size = stop - at
        return at, size, np.searchsorted(ends, at, "right") - 1

    def hashes(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint64)
        place = np.minimum(np.arange(at[0], at[-1] + size[-1]) - np.repeat(at, np.diff(np.append(at, at[-1] + size[-1]))), LONGEST)
        worth = self.weights[place] * (raw[at[0] : at[-1] + size[-1]].astype(np.uint64) + np.uint64(1))
        if self.kind == "word":
            worth[white(raw[at[0] : at[-1] + size[-1]])] = 0
        out = np.add.reduceat(worth, at - at[0]) + size.astype(np.uint64) * self.weights[LONGEST]
        return out ^ (out >> np.uint64(29))

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for distinct pieces, by the tokenizers library.

        A piece of Latin letters alone is one word to its tokenizer, and goes to the model directly.
        """
        flat, size, letters, tokenize, byte = [], [], self.letters, self.alone.model.tokenize, self.kind == "byte"
        for p in pieces:
            word = p[1:] if byte and p[0] == " " else p
            if word.isalpha() and max(word) < LATIN:
                ids = [t.id for t in tokenize((p if byte else p.lower()).encode().decode("latin-1").translate(letters))]
            else:
                ids = self.alone.encode(p, add_special_tokens=False).ids
            flat += ids
            size.append(len(ids))
        return np.array(flat, np.uint32), np.array(size, np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of sorted keys, and which keys are known."""
        at, size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for have, have_at, have_size in self.levels:
            if len(have):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                at[hit], size[hit] = have_at[i[hit]], have_size[i[hit]]
                known |= hit
        return at, size, known

    def keep_ids(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        at = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        into = 1 if len(self.levels[1][0]) < 100_000 else 0
        parts = [(keys, at, size), *(self.levels if into == 0 else self.levels[1:])]
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(merged[0], kind="stable")
        self.levels[into] = tuple(x[order] for x in merged)
        if into == 0:
            self.levels[1] = tuple(x[:0] for x in merged)

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: the UTF-8 bytes of all texts; ends: where they begin and end. All ids, and the number of each text's."""
        text = raw.tobytes()
        whole = [i for i in range(len(ends) - 1) if any(s in text[ends[i] : ends[i + 1]] for s in self.special)] if any(s in text for s in self.special) else []
        ids, sizes, at = [], [], 0
        for i in [*whole, len(ends) - 1]:
            if i > at:
                for got, to in zip(self.by_pieces(raw[ends[at] : ends[i]], ends[at : i + 1] - ends[at]), (ids, sizes), strict=True):
                    to.append(got)
            if i < len(ends) - 1:
                ids.append(np.array(self.alone.encode(text[ends[i] : ends[i + 1]].decode(), add_special_tokens=False).ids, np.uint32))
                sizes.append(np.array([len(ids[-1])], np.int64))
            at = i + 1
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def by_pieces(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without special tokens."""
        if self.used > 4 * self.keep or len(self.levels[0][0]) > self.keep:
            self.forget()
        at, size, row = self.find(raw, ends)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(ends) - 1, np.int64)
        keys, one, which = np.unique(self.hashes(raw, at, size), return_index=True, return_inverse=True)
        long = size[one] > LONGEST
        _, _, known = self.look(keys)
        text = raw.tobytes()
        new = np.flatnonzero(~known & ~long)
        if len(new):
            ids, n = self.ids_of([text[i : i + k].decode() for i, k in zip(at[one[new]].tolist(), size[one[new]].tolist(), strict=True)])
            self.keep_ids(keys[new], ids, n)
        begin, n, _ = self.look(keys)
        flat = self.flat
        if (far := np.flatnonzero(size > LONGEST)).size:  # long pieces: each by itself, ids behind the kept ones
            ids, own = self.ids_of([text[i : i + k].decode() for i, k in zip(at[far].tolist(), size[far].tolist(), strict=True)])
            flat = np.concatenate((self.flat[: self.used], ids))
            begin, n = begin[which], n[which]
            begin[far], n[far] = self.used + np.cumsum(own) - own, own
        else:
            begin, n = begin[which], n[which]
        return flat[ranges(begin, n)], np.bincount(row, n, len(ends) - 1).astype(np.int64)

    def slices(self, raw: np.ndarray, ends: np.ndarray, most: int = 1 << 20):
        """Encode about a megabyte of text at a time: first row, last row, ids, numbers of ids."""
        for i, j in row_slices(ends, most):
            yield i, j, *self.encode(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """One for each Python worker, which keeps its pieces from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]
