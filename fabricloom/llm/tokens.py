"""Token ids of public tokenizers, exactly as the tokenizers library gives them, with a bounded table of words.

Files of the two kinds that _kind() knows cut a text at single spaces and line feeds between other characters, and between an ASCII
letter or digit and a comma or full stop that ends a word, before any merge. So the ids of a text are the ids of
its words one after another. Words are found and hashed for a whole batch at once and looked up in a sorted table;
words that the table lacks go through the library. Texts where the cut doesn't hold (other or double spaces for
the file that keeps them, strings of special tokens) go through the library whole, and so do all texts with a file of
any other kind. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

from .anchors import A, B, U, mix, rolled, texts_of

#: Words at most in a worker's table; when full it starts anew.
WORDS = 1_500_000
COMMA, STOP, LINE, SPACE = 44, 46, 10, 32


#: Fixed value: the words that the pre-tokenizer of the first kind keeps.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kind(tokenizer) -> str | None:
    """How a tokenizer cuts texts: "words" (white space goes, small letters), "spaced" (a word carries the space before it),
    or None for what isn't known to be the same word by word."""
    import json

    about = json.loads(tokenizer.to_str())
    cut, normal = about["pre_tokenizer"] or {}, about["normalizer"] or {}
    if any(not t["content"].startswith("<|") or t["lstrip"] or t["rstrip"] for t in about["added_tokens"]) or about["model"]["type"] != "BPE":
        return None
    if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not normal:
        return "spaced"
    parts = cut.get("pretokenizers", [])
    if [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
        bytes_ = parts[1]
        plain = not bytes_["use_regex"] and not bytes_["add_prefix_space"]
        return "words" if plain and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] else None
    return None


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, with the table of words where the file is of a kind that allows
    it. spaced: which kind is expected."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.by_word = _kind(self.tokenizer) == ("spaced" if spaced else "words")
        self._clear()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        """The table: hashes in order, the entry of each; and each entry's ids in one array, with place and count.
        Entry 0 has none, then come comma, stop and line feed by themselves."""
        self.hashes, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        marks = [[], *self._whole([",", ".", "\n"])]
        self.counts = np.array([len(m) for m in marks])
        self.places = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.ids = np.array([i for m in marks for i in m], np.uint32)

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        found: list[list[int]] = []
        for begin in range(0, len(words), 20_000):
            found += self._whole(words[begin : begin + 20_000])
        counts = np.array([len(f) for f in found])
        flat = np.array([i for f in found for i in f], np.uint32)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.entries = np.insert(self.entries, at, len(self.counts) + np.arange(len(hashes)))
        self.places = np.concatenate([self.places, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat])

    def _odd_texts(self, data: np.ndarray, ends: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Which texts must go whole."""
        starts = np.concatenate([[0], ends[:-1]])
        after = np.append(data[1:], 0)
        bad = (data == 60) & (after == 124)  # the start of a special token
        if self.spaced:
            third = np.append(after[1:], 0)
            bad |= ((data >= 9) & (data <= 13) & (data != LINE)) | ((data >= 28) & (data <= 31))
            bad |= (data == 0xC2) & ((after == 0x85) | (after == 0xA0))
            bad |= (data == 0xE1) & (after == 0x9A) & (third == 0x80)
            bad |= (data == 0xE2) & (after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
            bad |= ((data == 0xE2) & (after == 0x81) & (third == 0x9F)) | ((data == 0xE3) & (after == 0x80) & (third == 0x80))
            bad[:-1] |= gap[:-1] & gap[1:]
            filled = ends > starts
            bad[starts[filled]] |= gap[starts[filled]]
            bad[ends[filled] - 1] |= gap[ends[filled] - 1]
        odd = np.zeros(len(ends), bool)
        odd[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
        return odd

    def encode(self, column) -> list[bytes]:
        """Ids of each text of an Arrow string column; a null text has none."""
        if not self.by_word:
            return [np.array(ids, "<u4").tobytes() for ids in self._whole([t or "" for t in column.to_pylist()])]
        data, ends = texts_of(column)
        n = len(data)
        if not n:
            return [b""] * len(ends)
        gap = (data == SPACE) | (data == LINE)
        odd = self._odd_texts(data, ends, gap)
        edge = np.zeros(n + 1, bool)
        edge[ends] = edge[0] = True
        solid = ~gap
        first = solid & edge[:-1]
        first[1:] |= solid[1:] & gap[:-1]
        last = solid & edge[1:]
        last[:-1] |= solid[:-1] & gap[1:]
        begins, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        whose = np.searchsorted(ends, begins, side="right")
        usual = ~odd[whose]
        begins, stops, whose = begins[usual], stops[usual], whose[usual]
        # the comma or stop at the end of a word
        final, before = data[stops - 1], data[np.maximum(stops - 2, 0)]
        plain = ((before >= 97) & (before <= 122)) | ((before >= 65) & (before <= 90)) | ((before >= 48) & (before <= 57))
        cut = (stops - begins > 1) & plain & ((final == COMMA) | (final == STOP))
        mark = np.where(cut, np.where(final == COMMA, 1, 2), 0)
        stops = stops - cut
        lead = np.zeros(len(begins), np.int64)  # with spaces: 1 for a word after one
        line = np.zeros(len(begins), np.int64)
        if self.spaced:
            inner = ~edge[begins]
            previous = data[np.maximum(begins - 1, 0)]
            lead[inner & (previous == SPACE)] = 1
            line[inner & (previous == LINE)] = 3
        hashes = mix(rolled(data, begins, stops) + lead.astype(np.uint64) * A)
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        known, example = ranked[fresh], order[fresh]
        if len(self.hashes) + len(known) > WORDS:
            self._clear()
        at = np.searchsorted(self.hashes, known)
        missing = np.ones(len(known), bool)
        inside = at < len(self.hashes)
        missing[inside] = self.hashes[at[inside]] != known[inside]
        if missing.any():
            raw, some = data.tobytes(), example[missing]
            spelled = zip(lead[some].tolist(), begins[some].tolist(), stops[some].tolist())
            self._add(known[missing], [(" " if s else "") + raw[a:b].decode("utf-8", "surrogatepass") for s, a, b in spelled])
            at = np.searchsorted(self.hashes, known)
        stem = np.empty(len(order), np.int64)
        stem[order] = self.entries[at][np.cumsum(fresh) - 1] if len(order) else 0
        parts = np.column_stack([line, stem, mark]).ravel() if self.spaced else np.column_stack([stem, mark]).ravel()
        width = 3 if self.spaced else 2
        counts = self.counts[parts]
        total = np.concatenate([[0], np.cumsum(counts)])
        out = self.ids[np.repeat(self.places[parts] - total[:-1], counts) + np.arange(total[-1])]
        raw = out.astype("<u4").tobytes()
        cuts = 4 * total[np.searchsorted(whose, np.arange(len(ends) + 1)) * width]
        found = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        rows = np.flatnonzero(odd).tolist()
        if rows:
            for r, ids in zip(rows, self._whole([column[r].as_py() for r in rows])):
                found[r] = np.array(ids, "<u4").tobytes()
        return found


_encoders: dict = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder a worker process and file."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
