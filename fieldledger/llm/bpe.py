"""Byte-pair encoding, exact and for many texts at a time, read from a public tokenizer file.

A vocabulary's pattern splits a text into independent words, so each distinct word is encoded once. Texts with characters
outside the plain set go to the library as a whole. Merges has what the transducer of token counts is built from.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-įĲ-ňŊ-ž"
SPACES = " \t\n\r"
PLAIN = re.compile(rf"[\t\n\r -~¡-©«-±´¶-¸»¿×÷–—‘’“”…€{LETTERS}]*")
LETTERS_RE = re.compile(f"[{LETTERS}]")
WHITE_BEGINS = re.compile(rf"[^{SPACES}][{SPACES}]")
LOWER_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^{SPACES}{LETTERS}0-9]+")
# Normalizer, pre-tokenizer and end of words of the two forms of file that are known.
FORMS = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, ""),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "</w>",
    ),
)
#: Pairs of tokens that the transducer remembers, per worker.
MEMO = 150_000
#: Words of more bytes are merged by the library.
LONGEST = 256
#: Characters that are split and merged at a time.
SLICE = 1 << 21
#: Words that are remembered, of so many bytes and ids at most, per worker.
PLACES, SHORT, FEW = 1 << 19, 16, 8
#: Moves that a pair may cause in the table of pairs; multipliers of its two places there.
MOVES = 64
HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Of eight bytes as a little-endian integer, the first so many.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: What runs of characters are: white space, letters, digits, others, and the end of a text.
WHITE, LETTER, DIGIT, OTHER, END = range(5)
# What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """The merge table alone: symbols of one word to tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.lower = bool(self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.chars = byte_symbols()
        self.longest = max(len(t.removesuffix(self.end)) if self.end else len(t) for t in self.vocab)
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, word: str) -> list[str]:
        chars = self.chars
        out = [chars[b] for b in word.encode()]
        if self.end and out:
            out[-1] += self.end
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """All merges in rank order."""
        ranks, parts = self.ranks, list(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i < len(parts) - 1 and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def beside(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens when they are neighbours."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.split(left) + self.split(right)) == [left, right]
        return known


class Batched:
    """Merges for many words at a time. Words of one length are the rows of a matrix of symbols; in each step every row
    merges its pair of the least rank, the first of equals, and rows without a known pair are done."""

    def __init__(self, merges: Merges):
        ids = merges.vocab
        pairs = sorted((ids[a] << 32 | ids[b], rank, ids[a + b]) for (a, b), rank in merges.ranks.items())
        keys = np.array([k for k, _, _ in pairs], np.int64)
        rank = np.array([r for _, r, _ in pairs], np.int32)
        self.made = np.zeros(len(pairs), np.int32)
        self.made[rank] = [m for _, _, m in pairs]
        self.none = np.int32(len(pairs))
        self._place(keys, rank)
        self.inside = np.array([ids[c] for c in merges.chars], np.int32)
        self.last = np.array([ids[c + merges.end] for c in merges.chars], np.int32)
        byte = np.arange(256)
        self.pairs = self.ranks(self.inside[byte][:, None], self.inside[byte][None, :]).ravel()
        self.end_pairs = self.ranks(self.inside[byte][:, None], self.last[byte][None, :]).ravel()
        self.dtype = np.dtype("<u2") if max(ids.values()) < 65536 else np.dtype("<u4")

    def _place(self, keys: np.ndarray, rank: np.ndarray) -> None:
        """A hash table with two places for each pair; what finds both taken moves another on, or else stays in sorted arrays."""
        self.shift = np.uint64(64 - max(8, 4 * len(keys)).bit_length())
        size = 1 << (64 - int(self.shift))
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, self.none, np.int32)
        rest = np.arange(len(keys))
        for probe in (0, 1):
            slot, one = np.unique(self._slot(keys[rest], probe), return_index=True)
            one, slot = one[self.slot_key[slot] < 0], slot[self.slot_key[slot] < 0]
            self.slot_key[slot], self.slot_rank[slot] = keys[rest[one]], rank[rest[one]]
            rest = np.delete(rest, one)
        left = []
        for key, own in zip(keys[rest].tolist(), rank[rest].tolist(), strict=True):
            at = -1
            for _ in range(MOVES):
                one, other = (int(self._slot(np.array([key]), probe)[0]) for probe in (0, 1))
                at = other if at == one else one
                self.slot_key[at], key = key, int(self.slot_key[at])
                self.slot_rank[at], own = own, int(self.slot_rank[at])
                if key < 0:
                    break
            else:
                left.append((key, own))
        left.sort()
        self.keys, self.rank = np.array([k for k, _ in left], np.int64), np.array([r for _, r in left], np.int32)

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((key.view(np.uint64) * HASHES[probe]) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        one, other = self._slot(key, 0), self._slot(key, 1)
        slot = np.where(self.slot_key[one] == key, one, other)
        out = np.where(self.slot_key[slot] == key, self.slot_rank[slot], self.none)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.rank[at], out)
        return out

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words at starts of the bytes raw: all in one array, and where each word's begin and how many they are."""
        parts, held = [], 0
        first, many = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order])) + 1
        for own in np.split(order, edges):
            if not len(own) or sizes[own[0]] > LONGEST:
                continue
            s = raw[starts[own][:, None] + np.arange(sizes[own[0]])]
            for done, found in self._merge(s):
                k = found.shape[1]
                first[own[done]] = held + k * np.arange(len(done))
                many[own[done]] = k
                parts.append(found.astype(self.dtype).ravel())
                held += found.size
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), first, many

    def _merge(self, raw: np.ndarray):
        """(rows, their symbols) of a matrix of words, as they are done."""
        s = self.inside[raw]
        s[:, -1] = self.last[raw[:, -1]]
        owner = np.arange(len(s))
        both = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        r = self.pairs[both]
        if raw.shape[1] > 1:
            r[:, -1] = self.end_pairs[both[:, -1]]
        while len(s):
            if s.shape[1] == 1:
                yield owner, s
                return
            j = r.argmin(1)
            least = r[np.arange(len(s)), j]
            done = least == self.none
            if done.any():
                yield owner[done], s[done]
                on = ~done
                s, owner, r, j, least = s[on], owner[on], r[on], j[on], least[on]
            row, at = np.arange(len(s)), j[:, None]
            places = np.arange(s.shape[1] - 1)
            s = np.where(places <= at, s[:, :-1], s[:, 1:])
            s[row, j] = self.made[least]
            r = np.where(places[:-1] < at, r[:, :-1], r[:, 1:])
            k = np.flatnonzero(j > 0)
            r[k, j[k] - 1] = self.ranks(s[k, j[k] - 1], s[k, j[k]])
            k = np.flatnonzero(j < s.shape[1] - 1)
            r[k, j[k]] = self.ranks(s[k, j[k]], s[k, j[k] + 1])


class Recent:
    """Short words and their ids, one at each place of a table: a later word takes an earlier one's place."""

    def __init__(self, dtype: np.dtype):
        self.many = np.zeros(PLACES, np.uint8)
        self.words, self.ids = np.zeros((PLACES, SHORT // 8), np.uint64), np.zeros((PLACES, FEW), dtype)

    @staticmethod
    def _slot(words: np.ndarray) -> np.ndarray:
        hashed = words[:, 0] * HASHES[0]
        hashed ^= words[:, 1] * HASHES[1]
        hashed ^= hashed >> np.uint64(32)
        return ((hashed * HASHES[0]) >> np.uint64(65 - PLACES.bit_length())).view(np.int64)

    @staticmethod
    def bytes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The words' first SHORT bytes, zeros behind their ends; raw goes on for SHORT bytes behind the last start."""
        out = np.empty((len(starts), SHORT // 8), np.uint64)
        for k in range(SHORT // 8):
            eight = np.ndarray(len(raw) - 8 * k - 7, "<u8", raw, 8 * k, (1,))
            np.bitwise_and(eight[starts], MASKS[np.clip(sizes - 8 * k, 0, 8)], out=out[:, k])
        return out

    def find(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of the words is here, by all its bytes, and its place."""
        slot = self._slot(words)
        there = self.words[slot]
        return (there[:, 0] == words[:, 0]) & (there[:, 1] == words[:, 1]) & (sizes <= SHORT), slot

    def keep(self, words: np.ndarray, sizes: np.ndarray, flat: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
        own = np.flatnonzero((sizes <= SHORT) & (many <= FEW))
        slot, one = np.unique(self._slot(words[own]), return_index=True)
        own = own[one]
        self.words[slot], self.many[slot] = words[own], many[own]
        self.ids[slot] = flat[np.minimum(first[own][:, None] + np.arange(FEW), max(len(flat) - 1, 0))] if len(flat) else 0


class Powers:
    """An odd number's powers modulo 2^64: the first and, of any places, the inverses; from two tables."""

    def __init__(self):
        base = 0x9E3779B97F4A7C15
        self.tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            low = np.full(4096, b, np.uint64)
            low[0] = 1
            low = np.cumprod(low, dtype=np.uint64)
            self.tables.append((low, pow(b, 4096, 1 << 64)))

    def _high(self, k: int, n: int) -> np.ndarray:
        high = np.full(n // 4096 + 1, self.tables[k][1], np.uint64)
        high[0] = 1
        return np.cumprod(high, dtype=np.uint64)

    def first(self, n: int) -> np.ndarray:
        return (self._high(0, n)[:, None] * self.tables[0][0][None, :]).ravel()[:n]

    def inverse(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the powers at places under n."""
        return self._high(1, n)[at >> 12] * self.tables[1][0][at & 4095]


POWERS = Powers()


class Encoder:
    """Whole texts to ids, equal to the library's encode(add_special_tokens=False).

    Texts of the plain set are cut into words as arrays of character classes; each distinct word of a slice is merged
    once and the ids are gathered word by word. Short words of earlier slices are remembered. Texts with other characters, and all
    texts where the file's normalizer or pattern is none of the two known ones, go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        merges = Merges(path)
        self.known = known_pattern(path)
        self.lower, self.chars = merges.lower, merges.chars
        self.batched = Batched(merges) if self.known else None
        self.dtype = self.batched.dtype if self.known else np.dtype("<u4")
        self.recent = Recent(self.dtype)
        table = np.full(0x2100, OTHER, np.uint8)
        table[[ord(c) for c in SPACES]] = WHITE
        table[[i for i in range(len(table)) if LETTERS_RE.match(chr(i))]] = LETTER
        table[ord("0") : ord("9") + 1] = DIGIT
        table[0] = END
        self.table = table

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list) -> list[np.ndarray]:
        """ids of each text; a null is empty."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        # texts of one byte a character go without others
        waiting, sizes = ([], []), [0, 0]

        def settle(wide: int) -> None:
            held = waiting[wide]
            if held:
                for (i, _), ids in zip(held, self._plain([t for _, t in held]), strict=True):
                    parts[i].append(ids)
                held.clear()
            sizes[wide] = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.known or "<|" in text or not PLAIN.fullmatch(text):
                parts[i].append(self._whole(text))
                continue
            for part in cut_at_white(text):
                part = part.lower() if self.lower else part
                wide = int(not part.isascii())
                waiting[wide].append((i, part))
                sizes[wide] += len(part)
                if sizes[wide] >= SLICE:
                    settle(wide)
        settle(0)
        settle(1)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, self.dtype) for p in parts]

    def _starts(self, char: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character; texts end in an END, which is a word of its own."""
        start = np.ones(len(char), bool)
        start[1:] = kind[1:] != kind[:-1]
        if self.lower:
            start |= kind == DIGIT
        else:  # the last of white space before a word is cut off; a blank goes with the word
            last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & (kind[1:] != END))
            start[last] = True
            start[last[char[last] == 32] + 1] = False
        a = np.flatnonzero((char == 39) & start)
        a = a[kind[a + 1] == LETTER]
        one = a[np.isin(char[a + 1], [ord(c) for c in CONTRACTIONS if len(c) == 1])]
        start[one + 1], start[one + 2] = False, True
        pair = char[a + 1].astype(np.int64) << 16 | char[a + 2]
        two = a[np.isin(pair, [ord(c[0]) << 16 | ord(c[1]) for c in CONTRACTIONS if len(c) == 2])]
        start[two + 1], start[two + 2], start[two + 3] = False, False, True
        return start

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        coded = joined.encode()
        raw = np.frombuffer(coded + bytes(SHORT), np.uint8)
        char = raw[: len(coded)] if len(coded) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.table[char]
        at = np.flatnonzero(self._starts(char, kind))
        end = np.append(at[1:], len(char))
        own = kind[at]
        wanted = (own != END) & (own != WHITE) if self.lower else own != END
        upto = np.cumsum(wanted)[np.flatnonzero(own == END)]  # words up to the end of each text
        at, end = at[wanted], end[wanted]
        if len(coded) != len(char):  # places of characters to places of bytes
            place = np.concatenate([[0], np.cumsum(1 + (char >= 0x80) + (char >= 0x800))])
            at, end = place[at], place[end]
        ids, edges = self._ids(raw, at, end - at)
        edges = edges[np.concatenate([[0], upto])]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _ids(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and where each word's begin; words that are not remembered are merged once and remembered."""
        words = Recent.bytes(raw, at, sizes)
        hit, slot = self.recent.find(words, sizes)
        rest, hit = np.flatnonzero(~hit), np.flatnonzero(hit)
        slot = slot[hit]
        n = np.empty(len(at), np.int64)
        n[hit] = many = self.recent.many[slot]
        inverse, one = self._distinct(raw, at[rest], sizes[rest])
        one = rest[one]
        flat, first, found = self._long(raw, at[one], sizes[one], *self.batched.encode(raw, at[one], sizes[one]))
        n[rest] = found[inverse]
        edges = np.concatenate([[0], np.cumsum(n)])
        ids, known, to = np.empty(edges[-1], self.dtype), self.recent.ids.ravel(), edges[hit]
        slot = slot * FEW
        for k in range(FEW):
            if k:
                on = np.flatnonzero(many > k)
                slot, to, many = slot[on], to[on], many[on]
            if not len(slot):
                break
            ids[to + k] = known[slot + k]
        n = n[rest]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids[np.repeat(edges[rest], n) + inside] = flat[np.repeat(first[inverse], n) + inside]
        self.recent.keep(words[one], sizes[one], flat, first, found)
        return ids, edges

    def _long(self, raw, at, sizes, flat, first, many):
        for i in np.flatnonzero(sizes > LONGEST):
            symbols = "".join([self.chars[b] for b in raw[at[i] : at[i] + sizes[i]].tolist()])
            ids = np.array([t.id for t in self.library.model.tokenize(symbols)], self.dtype)
            first[i], many[i] = len(flat), len(ids)
            flat = np.append(flat, ids)
        return flat, first, many

    @staticmethod
    def _distinct(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its kind, and for each kind one word. Kinds are found by hashes and then compared."""
        n = np.concatenate([[0], np.cumsum(sizes)])
        raw, at = raw[np.repeat(at - n[:-1], sizes) + np.arange(n[-1])], n[:-1]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS.first(len(raw)), out=total[1:])
        hashed = (total[at + sizes] - total[at]) * POWERS.inverse(at, len(raw) + 1)
        hashed ^= hashed >> np.uint64(29)
        _, one, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        same = bool((sizes[one][inverse] == sizes).all())
        if not (same and bool((raw == raw[np.repeat(at[one][inverse] - at, sizes) + np.arange(n[-1])]).all())):
            words: dict[bytes, int] = {}  # two words of one hash: tell them apart by their bytes
            inverse = np.array([words.setdefault(raw[a : a + k].tobytes(), len(words)) for a, k in zip(at, sizes, strict=True)], np.int64)
            _, one = np.unique(inverse, return_index=True)
        return inverse, one


def cut_at_white(text: str) -> list[str]:
    """Parts of some SLICE characters, cut where white space begins: no word reaches across."""
    parts, at = [], 0
    while len(text) - at > SLICE:
        found = WHITE_BEGINS.search(text, at + SLICE)
        if found is None:
            break
        parts.append(text[at : found.end() - 1])
        at = found.end() - 1
    parts.append(text[at:])
    return parts


def known_pattern(path: str) -> bool:
    """Whether a file's normalizer, pre-tokenizer and model are of one of the known forms."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    form = (spec.get("normalizer"), spec.get("pre_tokenizer"), model.get("end_of_word_suffix") or "")
    return plain and form in FORMS and not spec.get("truncation") and not spec.get("padding")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
