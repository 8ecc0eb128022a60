"""Cached tokenisation of whole texts, vectorised over the bytes of many documents.

A tokenizer that lower-cases, drops white space and never joins letters, single digits and other marks
(checked in its file, ``_splits_words``) gives each piece of a text the same ids wherever it stands.
Pieces are found and hashed (64 bits) by numpy; only a piece not seen before meets the tokenizer.
Texts that hold an added token, and all texts of any other tokenizer, are encoded plainly.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from ._bytes import SPACE, find_words, hash_spans, text_slices

#: Pieces kept by a worker before its cache starts anew; bounds memory, never changes results.
CACHE_ENTRIES = 400_000
#: Bytes of text handled at once (more only where one row is longer).
SLICE_BYTES = 1 << 20
#: Pieces encoded at once.
JOIN = 8_192

#: The normaliser and pre-tokeniser that the piece-wise way is right for.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[SPACE] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _OTHER
#: Bytes whose words are not cut at every change of class: non-ASCII ones and the apostrophe of contractions.
_UNCUT = np.zeros(256, bool)
_UNCUT[128:] = True
_UNCUT[39] = True
#: Marks that may be cut off the end of such a word.
_ENDING = np.zeros(256, bool)
_ENDING[[ord(c) for c in ".,;:!?*#$%&|"]] = True


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _splits_words(tokenizer: dict) -> bool:
    """Whether the pieces of a text can be encoded one by one with the same result."""
    normalizer, pre = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    cut = [p for p in pre.get("pretokenizers", []) if p.get("type") == "Split"]
    return (
        normalizer.get("normalizers") == WORD_NORMALIZERS
        and [(p["pattern"].get("Regex"), p["behavior"], p["invert"]) for p in cut] == [(WORD_PATTERN, "Removed", True)]
        and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]
        and tokenizer["model"].get("type") == "BPE"
        and not tokenizer["model"].get("dropout")
        and not (tokenizer.get("truncation") or tokenizer.get("padding"))
        and all(t["special"] for t in tokenizer.get("added_tokens", []))
    )


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and for each row the index of its first piece (one more at the end).

    ASCII words are cut into runs of letters, single digits and runs of other marks. A word with an
    apostrophe or a non-ASCII byte stays whole, but for marks after a letter or digit at its end.
    """
    starts, ends, _ = find_words(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(len(offsets), np.int64)
    n = len(data)
    count = np.zeros(n + 1, np.int32)
    np.cumsum(_UNCUT[data], out=count[1:])
    uncut = count[ends] > count[starts]
    kind = _CLASS[data]
    begins = np.zeros(n, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    if uncut.any():
        low, high = starts[uncut], ends[uncut]
        edge = np.zeros(n + 1, np.int8)
        edge[low] += 1
        edge[high] -= 1
        begins[np.cumsum(edge[:-1], dtype=np.int8) > 0] = False
        core = high.copy()
        moving = np.arange(len(core))
        while len(moving):
            moving = moving[(core[moving] > low[moving]) & _ENDING[data[np.maximum(core[moving] - 1, 0)]]]
            core[moving] -= 1
        cut = (core > low) & (core < high)
        core = core[cut]
        last = data[core - 1]
        # A letter or digit stands before the marks: ASCII, or Latin of two bytes (U+00C0 to U+017F but for the signs).
        lead = data[np.maximum(core - 2, 0)]
        latin = (last >= 0x80) & (((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | (lead == 0xC4) | (lead == 0xC5))
        begins[core[(kind[core - 1] == _LETTER) | (kind[core - 1] == _DIGIT) | latin]] = True
    begins[starts] = True
    begins &= kind != _SPACE
    first = np.flatnonzero(begins)
    # A piece ends where the next begins or its word ends.
    word = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], n), ends[word])
    return first, last, np.searchsorted(first, offsets)


class _Encoder:
    """Ids of pieces by hash, kept in one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.by_piece = _splits_words(told)
        self.added = [t["content"].encode() for t in told.get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros((1 << 14) + 1, np.int64)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, texts: list[str]):
        """Encoding of pieces that holds no added token, as pieces of any case share one entry."""
        self.tokenizer.encode_special_tokens = True
        told = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        self.tokenizer.encode_special_tokens = False
        return told

    def learn(self, hashes: list[int], texts: list[str]) -> None:
        """Encode unseen pieces; ASCII letters need only the merge model."""
        found: list = [None] * len(texts)
        model, joined = self.tokenizer.model, []
        for i, t in enumerate(texts):
            if t.isascii() and t.isalpha():
                found[i] = [x.id for x in model.tokenize(t.lower())]
            else:
                joined.append(i)
        for low in range(0, len(joined), JOIN):
            part = joined[low : low + JOIN]
            told = self._joined([texts[i] for i in part])
            starts = np.cumsum([0, *(len(texts[i]) + 1 for i in part)])
            at = np.fromiter((o[0] for o in told.offsets), np.int64, len(told.ids))
            ends = np.searchsorted(at, starts).tolist()
            ids = told.ids
            for k, i in enumerate(part):
                found[i] = ids[ends[k] : ends[k + 1]]
        n = len(self.slots)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if n + len(found) >= len(self.at):
            self.at = np.concatenate((self.at, np.zeros(max(len(self.at), len(found)), np.int64)))
        self.at[n + 1 : n + len(found) + 1] = self.at[n] + np.cumsum(sizes)
        low, high = self.at[n], self.at[n + len(found)]
        if high > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), high - low), np.uint32)))
        self.flat[low:high] = [x for ids in found for x in ids]
        self.slots.update(zip(hashes, range(n, n + len(found)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of ``data`` cut at ``offsets``."""
        first, last, rows = pieces(data, offsets)
        hashes, spot, which = np.unique(hash_spans(data, first, last), return_index=True, return_inverse=True)
        if len(self.slots) > CACHE_ENTRIES:
            self.forget()
        keys = hashes.tolist()
        unseen = [i for i, h in enumerate(keys) if h not in self.slots]
        if unseen:
            raw = data.tobytes()
            bounds = zip(first[spot[unseen]].tolist(), last[spot[unseen]].tolist(), strict=True)
            self.learn([keys[i] for i in unseen], [raw[a:b].decode() for a, b in bounds])
        slot = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        start, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        count = size[which]
        ends = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(start[which] - ends[:-1], count) + np.arange(ends[-1])]
        cuts = ends[rows]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for r in self._rows_with_added(data, offsets):
            out[r] = self.plain(data[offsets[r] : offsets[r + 1]].tobytes().decode())
        return out

    def _rows_with_added(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        raw = data.tobytes()
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        return found


_loaded: dict[str, _Encoder] = {}


def encode_many(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of whole texts, as by the tokenizer itself; null reads as empty."""
    encoder = _loaded.get(path)
    if encoder is None:
        encoder = _loaded[path] = _Encoder(path)
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(texts, SLICE_BYTES):
        if encoder.by_piece:
            out.extend(encoder.encode(data, offsets))
        else:
            raw = data.tobytes()
            out.extend(encoder.plain(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return out
