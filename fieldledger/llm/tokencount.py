"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The text is normalised and read by a deterministic scanner of word classes (letters, single digits, other runs, seven
contractions), and the symbols of each word by a deterministic transducer whose transitions carry counts. A state is
what the future of a word depends on: the longest end of its prefix that begins some vocabulary entry and, for each
start inside it, the last token of the encoding up to there and how many tokens it has beyond or short of now. Reading
a symbol finds the one vocabulary entry that ends there and may stand beside the token before it; the transition emits
the change of the count. States are compiled when first reached and kept, as lazy automata are.

A chunk of a text becomes a state map. Wherever a word ends whatever the state was (at white space, after a digit, and
where letters and other characters meet, but not after an apostrophe) all entry states become one, so a map is the head
up to the first such place, which is run from the entry state, the count from there to the end, and the exit state. State
maps compose associatively; a scan of doubling strides composes the chunks of a text. Texts beyond LONG characters are
cut into rows, mapped on many tasks and composed from their small maps. Only a chunk that is all one word has no such
place; its map is its text.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.bpe import LETTERS, LOWER_WORDS, PLAIN, Merges
from fieldledger.session import table

CHUNK = 1 << 16
LONG = 1 << 20
LIMIT = 2048
MAX_STATES = 250_000
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed values of the vocabulary's pattern: what follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
ANY_WORDS = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
ANY_WHITE = re.compile(f"[{WHITE}]+")
PLAIN_LETTER = re.compile(f"[{LETTERS}]")
#: Characters before which a word ends, whatever was read before; the same from the end of a text.
MEETING = rf"(?<=\p{{N}})[\s\S]|(?<=\p{{L}})[^\p{{L}}]|(?<=[^{WHITE}\p{{L}}\p{{N}}'])[{WHITE}\p{{L}}\p{{N}}]|[{WHITE}]"
FIRST_MEETING, LAST_MEETING = regex.compile(MEETING), regex.compile(f"(?r){MEETING}")


class Transducer:
    """Symbols of words to token counts."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        vocab, end = self.merges.vocab, self.merges.end
        self.whole = {t for t in vocab if not t.endswith(end)}
        self.final = {t.removesuffix(end) for t in vocab if t.endswith(end) and t != end}
        self.begins = {t[:k] for t in self.whole | self.final for k in range(len(t))}
        self.special = self.merges.special
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.restart()

    def restart(self) -> None:
        self.ids: dict = {}
        self.keys: list = []
        self.moves: list[dict] = []
        self.ends: list[dict] = []
        self.start = self.state((("", "", 0),))

    def trim(self) -> None:
        """Between texts: forgets the compiled states when there are many."""
        if len(self.keys) > MAX_STATES:
            self.restart()

    def state(self, key: tuple) -> int:
        """key: (text since a start, last token before it, its count less the present one), longest first."""
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            self.ends.append({})
        return found

    def _fits(self, before: str, token: str) -> bool:
        merges = self.merges
        return merges.beside(before, token) if before else merges.merge(merges.split(token)) == [token]

    def _step(self, key: tuple, symbol: str) -> tuple[tuple, int]:
        for text, before, count in key:
            token = text + symbol
            if token in self.whole and self._fits(before, token):
                delta = count + 1
                after = tuple((t + symbol, b, n - delta) for t, b, n in key if t + symbol in self.begins)
                return (*after, ("", token, 0)), delta
        raise ValueError(f"no entry ends in {symbol!r}")

    def move(self, state: int, char: str) -> tuple[int, int]:
        """Next state and emitted count for one character (one symbol a byte) that does not end the word."""
        key, total = self.keys[state], 0
        for b in char.encode():
            key, delta = self._step(key, self.merges.chars[b])
            total += delta
        got = self.moves[state][char] = (self.state(key), total)
        return got

    def end(self, state: int, char: str) -> int:
        """Emitted count for the character that ends the word."""
        key, total = self.keys[state], 0
        *body, last = [self.merges.chars[b] for b in char.encode()]
        for symbol in body:
            key, delta = self._step(key, symbol)
            total += delta
        end = self.merges.end
        for text, before, count in key:
            token = text + last
            if token in self.final and self._fits(before, token + end):
                got = self.ends[state][char] = total + count + 1
                return got
        raise ValueError(f"no entry ends in {last!r}")

    def count(self, words: list[str]) -> int:
        """Tokens of whole words."""
        moves, ends, total = self.moves, self.ends, 0
        for word in words:
            state = self.start
            for char in word[:-1]:
                state, delta = moves[state].get(char) or self.move(state, char)
                total += delta
            last = word[-1]
            delta = ends[state].get(last)  # often 0
            total += self.end(state, last) if delta is None else delta
        return total


def kind(char: str) -> str:
    """Class of a normalised character."""
    if ANY_WHITE.match(char):
        return " "
    if PLAIN_LETTER.match(char):
        return "L"
    major = unicodedata.category(char)[0]
    return major if major in "LN" else "P"


@dataclass(frozen=True)
class Exit:
    """State between characters: the open word's class, its compiled state as a key, and its pending character.

    Classes: S none, L letters, P others, A an apostrophe that may open a contraction, and its unfinished letter.
    """

    mode: str = "S"
    key: tuple = (("", "", 0),)
    pending: str = ""


@dataclass
class StateMap:
    """What a chunk does: text up to where all states meet, count after that, exit state; or head alone, if nowhere."""

    head: str
    count: int = 0
    exit: Exit | None = None


class Counter:
    """Runs the scanner and the transducer."""

    def __init__(self, path: str):
        self.machine = Transducer(path)

    def normalise(self, text: str) -> tuple[str, int]:
        """Normalised text and how many special strings it had; each counts as one token and splits its surroundings."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return text.lower(), 0
        parts = self.machine.cut.split(text) if self.machine.cut else [text]
        lowered = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts]
        return " ".join(lowered), len(parts) - 1

    def words(self, text: str) -> list[str]:
        return (LOWER_WORDS if PLAIN.fullmatch(text) else ANY_WORDS).findall(text)

    def read(self, at: Exit, text: str) -> tuple[Exit, int]:
        """Character by character from any state."""
        machine, total = self.machine, 0
        mode, pending = at.mode, at.pending
        state = machine.state(at.key)

        def close() -> int:
            if mode in ("S",):
                return 0
            if mode in ("A", "r", "v", "l"):  # not a contraction after all
                return machine.count(["'"]) + (machine.count([mode]) if mode != "A" else 0)
            return machine.end(state, pending)

        for c in text:
            cls = kind(c)
            if mode in ("r", "v", "l"):
                if mode + c in CONTRACTIONS:
                    total += machine.count(["'" + mode + c])
                    mode = "S"
                    continue
                total += machine.count(["'"])
                state, pending, mode = machine.start, mode, "L"
            elif mode == "A":
                if c in CONTRACTIONS:
                    total += machine.count(["'" + c])
                    mode = "S"
                    continue
                if c in "rvl":
                    mode = c
                    continue
                if cls == "P":
                    state, pending, mode = machine.start, "'", "P"
                else:
                    total += machine.count(["'"])
                    mode = "S"
            if mode == cls and mode in "LP":
                state, delta = machine.moves[state].get(pending) or machine.move(state, pending)
                total += delta
                pending = c
                continue
            total += close()
            mode, state, pending = "S", machine.start, ""
            if cls == "N":
                total += machine.count([c])
            elif c == "'":
                mode = "A"
            elif cls in "LP":
                mode, pending = cls, c
        return Exit(mode, machine.keys[state] if mode in "LP" else (("", "", 0),), pending), total

    def close(self, at: Exit) -> int:
        """Count of what is still open at the end of the text: white space closes it."""
        return self.read(at, " ")[1]

    def map(self, text: str) -> StateMap:
        """State map of a normalised chunk."""
        first = FIRST_MEETING.search(text)
        if first is None:
            return StateMap(text)
        at, k = first.start(), LAST_MEETING.search(text).start()
        exit_, n = self.read(Exit(), text[k:])
        return StateMap(text[:at], self.machine.count(self.words(text[at:k])) + n, exit_)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.exit is None:
            return StateMap(a.head + b.head, b.count, b.exit)
        after, n = self.read(a.exit, b.head)
        if b.exit is None:
            return StateMap(a.head, a.count + n, after)
        return StateMap(a.head, a.count + n + self.close(after) + b.count, b.exit)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive scan by doubling strides; the last is the whole text's map."""
        stride = 1
        while stride < len(maps):
            maps = [self.compose(maps[i - stride], m) if i >= stride else m for i, m in enumerate(maps)]
            stride *= 2
        return maps

    def total(self, maps: list[StateMap]) -> int:
        """Tokens of the text whose chunks these are."""
        whole = self.scan(maps)[-1]
        at, n = self.read(Exit(), whole.head)
        n += self.close(at)
        return n if whole.exit is None else n + whole.count + self.close(whole.exit)

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        self.machine.trim()
        lowered, extra = self.normalise(text)
        if len(lowered) <= CHUNK:
            return extra + self.machine.count(self.words(lowered))
        return extra + self.total([self.map(lowered[k : k + CHUNK]) for k in range(0, len(lowered), CHUNK)])


def safe_cut(text: str, at: int) -> int:
    """The first place from at where neither normalisation nor a special string reaches across."""
    while at < len(text):
        a, b = text[at - 1], text[at]
        if (a < "\x80" and b < "\x80") or (
            not unicodedata.combining(b)
            and unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)
        ):
            k = text.rfind("<|", max(0, at - 16), at + 1)
            if k < 0 or "|>" in text[k:at]:
                return at
        at += 1
    return len(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process and vocabulary."""
    return Counter(path)


def _counted(path: str):
    def run(batches):
        count = counter(path).tokens
        for batch in batches:
            n = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _pieces(batches):
    """Very long texts to rows of chunks."""
    for batch in batches:
        for k, text in enumerate(batch.column("text").to_pylist()):
            own, at, seq = [batch.column(c).slice(k, 1) for c in ("row", "doc_id", "n_bytes")], 0, 0
            while at < len(text):
                to = safe_cut(text, at + CHUNK)
                yield pa.RecordBatch.from_arrays([*own, pa.array([seq], pa.int64()), pa.array([text[at:to]])], ["row", "doc_id", "n_bytes", "seq", "chunk"])
                at, seq = to, seq + 1


def _mapped(path: str):
    def run(batches):
        c = counter(path)
        for batch in batches:
            maps = []
            for text in batch.column("chunk").to_pylist():
                c.machine.trim()
                lowered, extra = c.normalise(text)
                got = c.map(lowered)
                maps.append(pickle.dumps((got.head, got.count, extra, got.exit and (got.exit.mode, got.exit.key, got.exit.pending))))
            own = [batch.column(x) for x in ("row", "doc_id", "n_bytes", "seq")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(maps, pa.binary())], ["row", "doc_id", "n_bytes", "seq", "map"])

    return run


def _composed(path: str):
    def run(rows: pa.Table) -> pa.Table:
        c, rows = counter(path), rows.sort_by("seq")
        found = [pickle.loads(m) for m in rows.column("map").to_pylist()]
        maps = [StateMap(head, count, exit_ and Exit(*exit_)) for head, count, _, exit_ in found]
        n = c.total(maps) + sum(extra for _, _, extra, _ in found)
        return pa.table({"doc_id": rows.column("doc_id")[:1], "n_bytes": rows.column("n_bytes")[:1], "n_tokens": pa.array([n], pa.int64())})

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, long: int = LONG) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document.

    docs: doc_id, text; further columns are not looked at. A null or empty text has no bytes and no tokens. Rows that
    repeat a doc_id, null ones too, are counted one by one. An empty table gives no rows.
    """
    kind_ = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = f"doc_id {kind_}, n_bytes long, n_tokens long"
    short = rows.filter(F.length("text") <= long).mapInArrow(_counted(path), out)
    over = (
        rows.filter(F.length("text") > long)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(_pieces, f"row long, doc_id {kind_}, n_bytes long, seq long, chunk string")
        .repartition("row", "seq")
        .mapInArrow(_mapped(path), f"row long, doc_id {kind_}, n_bytes long, seq long, map binary")
        .groupBy("row")
        .applyInArrow(_composed(path), out)
    )
    return short.unionByName(over).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
