"""Token counts of every prefix of a text, by dynamic programming over its prefixes.

In a byte-pair encoding a sequence of pieces is the encoding of its text exactly if each piece encodes to itself and each two
neighbours stay apart when encoded together. So the encoding of a prefix is that of a shorter prefix and one last piece, and only one
piece can be last: count[i] = count[i - len(piece)] + 1. Whether two pieces stay apart is asked of the library once for each pair.

No piece of the vocabulary reaches across two characters that stand together in none of them. Texts are cut there into
units (a word with its leading spaces and its punctuation), whose counts add up, so a unit is worked out once in a task however often it comes."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import pieces

SPACE = "▁"  # how the library writes a space
SLICE = 1 << 20
#: Units and pairs that a task remembers (half as many units' first characters), and how many characters those are.
REMEMBER, STEM = 450_000, 6
#: Merged over a model's message: no space is put before a text.
_BARE = b"\x1a\x02\x18\x00"


class PrefixCounter:
    """Steps between the counts of a text's prefixes, for a SentencePiece BPE model that leaves texts as they are and puts one space before them."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        with open(model, "rb") as f:
            raw = f.read()
        self.whole, self.bare = SentencePieceProcessor(), SentencePieceProcessor()
        self.whole.load_from_serialized_proto(raw)
        self.bare.load_from_serialized_proto(raw + _BARE)
        if self.whole.normalize("Ａ ﬁ  x ") != f"{SPACE}Ａ{SPACE}ﬁ{SPACE * 2}x{SPACE}":
            raise ValueError(f"{model} changes texts before it encodes them; prefixes of the text are then none of what is encoded")
        names = {k: self.whole.id_to_piece(k) for k in range(self.whole.get_piece_size()) if not (self.whole.is_control(k) or self.whole.is_unknown(k) or self.whole.is_byte(k))}
        self.pieces = {p for k, p in names.items() if self.bare.encode(p) == [k]}
        #: How long the pieces are that end with these three, two or one characters, longest first.
        ends: dict[str, set[int]] = defaultdict(set)
        for p in self.pieces:
            for k in range(1, min(3, len(p)) + 1):
                ends[p[-k:]].add(len(p))
        short = {tail: {n for n in ends[tail[1:]] if n < len(tail)} | ({n for n in ends[tail[2:]] if n < 2} if len(tail) > 2 else set()) for tail in list(ends) if len(tail) > 1}
        self.ends = {tail: tuple(sorted(sizes | short.get(tail, set()), reverse=True)) for tail, sizes in ends.items()}
        self.joined = joined = {a + b for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        bound = {c for two in joined for c in two} - {SPACE}
        inside = "".join(map(re.escape, sorted(bound)))
        across = any(two[1] == SPACE != two[0] for two in joined)  # a piece that reaches over a space: no cut before spaces
        self.unit = re.compile(f"[{SPACE}{inside}]+|[^{SPACE}{inside}]+" if across else f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]+")
        self.cut = None if across else re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stems: dict[str, tuple[list[str], list[int]]] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the pair encodes to itself; asked where it is not remembered."""
        if len(self.apart) >= REMEMBER:
            self.apart.clear()
        found = self.apart[a, b] = self.bare.encode(a + b, out_type=str) == [a, b]
        return found

    def unit_steps(self, unit: str) -> bytes:
        """The steps of one unit, as 32-bit integers; those of one that ends with a sign, from its parts that no piece reaches across."""
        if unit[-1].isalpha():
            return self.part_steps(unit)
        found, at, joined = [], 0, self.joined
        for to in range(1, len(unit) + 1):
            if to == len(unit) or unit[to - 1 : to + 1] not in joined:
                part = unit[at:to]
                found.append(self.known.get(part) or self.recall(part) or self.remember(part, self.part_steps(part)))
                at = to
        return b"".join(found)

    def part_steps(self, part: str) -> bytes:
        """By the recurrence, from what is remembered of the part's first characters."""
        if len(part) <= STEM:
            last, count = [""], [0]
        else:
            stem = self.stems.get(part[:STEM])
            if stem is None:
                if len(self.stems) >= REMEMBER // 2:
                    self.stems.clear()
                stem = self.stems[part[:STEM]] = self.grown(part[:STEM], [""], [0])
            last, count = stem[0].copy(), stem[1].copy()
        _, count = self.grown(part, last, count)
        return array("i", map(sub, count[1:], count)).tobytes()

    def grown(self, part: str, last: list[str], count: list[int]) -> tuple[list[str], list[int]]:
        """The last pieces and counts of all prefixes, from those of the first ones. A character in no piece is as many tokens as it has
        bytes, apart from all others."""
        known, ends, apart = self.pieces, self.ends, self.apart
        for end in range(len(last), len(part) + 1):
            for size in (end > 2 and ends.get(part[end - 3 : end])) or (end > 1 and ends.get(part[end - 2 : end])) or ends.get(part[end - 1], ()):
                if size <= end:
                    piece = part[end - size : end]
                    if piece in known:
                        before = last[end - size]
                        fits = not before or apart.get((before, piece))
                        if fits is None:
                            fits = self.stay_apart(before, piece)
                        if fits:
                            last.append(piece)
                            count.append(count[end - size] + 1)
                            break
            else:
                last.append("")
                count.append(count[-1] + len(part[end - 1].encode()))
        return last, count

    def remember(self, unit: str, step: bytes) -> bytes:
        if len(unit) <= 64:
            if len(self.known) >= REMEMBER:
                self.older, self.known = self.known, {}
            self.known[unit] = step
        return step

    def recall(self, unit: str) -> bytes | None:
        """What has not come for a while goes: when the memory is full, only what is asked again passes into the next one."""
        step = self.older.get(unit)
        return step if step is None else self.remember(unit, step)

    def steps(self, text: str) -> np.ndarray:
        """One for each code point: the count of the prefix that it ends, less that of the prefix before (0 for the empty one)."""
        if not text:
            return np.zeros(0, np.int8)
        text, parts, at = SPACE + text.replace(" ", SPACE), [], 0
        while at < len(text):
            found = self.cut.search(text, at + SLICE) if self.cut else None
            to = found.start() if found else len(text)
            own, known = [], self.known
            for unit in self.unit.findall(text, at, to):
                step = self.known.get(unit)
                if step is None:
                    step = self.remember(unit, self.unit_steps(unit))
                own.append(step)
            part = np.frombuffer(b"".join(own), np.int32)
            parts.append(part.astype(np.min_scalar_type(-max(1, int(np.abs(part).max())))))
            at = to
        steps = np.concatenate(parts)  # in the widest type of any part
        steps[1] += steps[0]  # the space put before the text belongs to its first character
        return steps[1:]


@functools.cache
def counter(model: str) -> PrefixCounter:
    """Of a file, or of a public tokenizer by its name: a task finds it on its own machine."""
    if not os.path.exists(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    return PrefixCounter(model)


def prefix_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_chars, n_tokens, steps): the token count of every prefix of every text.

    `steps` holds one little-endian integer of 1, 2 or 4 bytes (as many as the text needs) for each code point: what it adds to the
    count, so a running sum gives the count of every prefix, and n_tokens is that of the whole text. Ask it with `tokens_at`
    and `prefix_within`. Rows are worked out where they are read, with no shuffle; a text of any length is cut into slices between
    units. A null text counts as empty (no tokens), a null key passes through, repeated rows are counted alike, other columns are not
    read, an empty table gives an empty result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch, raw in pieces(batches, "text"):
            found = [own.steps(x.decode("utf-8")) for x in raw]
            numbers = ([len(x) for x in raw], [len(s) for s in found], [int(s.sum(dtype=np.int64)) for s in found])
            steps = pa.array([s.astype(s.dtype.newbyteorder("<")).tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), steps], names=["key", "n_bytes", "n_chars", "n_tokens", "steps"])

    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_bytes long, n_chars long, n_tokens long, steps binary").withColumnRenamed("key", key)


def _running(raw: bytes, chars: int) -> np.ndarray:
    """The counts of all prefixes, the empty one first."""
    steps = np.frombuffer(raw, f"<i{len(raw) // chars}") if chars else np.zeros(0, np.int8)
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


def tokens_at(chars: Column | int, steps: str = "steps", n_chars: str = "n_chars") -> Column:
    """How many tokens the prefix of so many code points has (the whole text's, if it has no more; null for null or less than none)."""

    @F.pandas_udf("long")
    def ask(raw: pd.Series, own: pd.Series, at: pd.Series) -> pd.Series:
        found = [None if r is None or pd.isna(a) or a < 0 else int(_running(r, n)[min(int(a), n)]) for r, n, a in zip(raw, own, at, strict=True)]
        return pd.Series(found, dtype="Int64")

    return ask(F.col(steps), F.col(n_chars), (chars if isinstance(chars, Column) else F.lit(chars)).cast("long"))


def prefix_within(budget: Column | int, steps: str = "steps", n_chars: str = "n_chars") -> Column:
    """The longest prefix, in code points, of at most so many tokens (null for null or less than none).

    A longer prefix may have fewer tokens than a shorter one, as characters merge, so this is not where the count first exceeds the budget."""

    @F.pandas_udf("long")
    def ask(raw: pd.Series, own: pd.Series, most: pd.Series) -> pd.Series:
        found = [None if r is None or pd.isna(m) or m < 0 else int(np.flatnonzero(_running(r, n) <= int(m))[-1]) for r, n, m in zip(raw, own, most, strict=True)]
        return pd.Series(found, dtype="Int64")

    return ask(F.col(steps), F.col(n_chars), (budget if isinstance(budget, Column) else F.lit(budget)).cast("long"))
