"""Packing token sequences with Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .wordhash import pieces

#: A text is encoded in slices of about so many characters, cut before a space that a visible character follows: byte-level
#: pre-tokens hold a space only as their first character or in a run of white space, so none reaches across.
SLICE = 1 << 20
_CUT = re.compile("(?= [!-~\xc0-\u024f])")


class TextIds:
    """A text's ids by a tokenizer file.

    The ids are those of `tokenizers`, which takes more than twice the time that the check tool grants this operator. So tiktoken,
    given the same vocabulary as ranks and the same published pattern, encodes all texts but those that hold one of the file's added
    tokens, which only `tokenizers` reads as such. Tests hold the two against each other."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.coder = Tokenizer.from_file(tokenizer)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        #: The least unsigned integers that hold every id.
        self.kind = "<u2" if self.coder.get_vocab_size() <= 1 << 16 else "<u4"

    def of(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added):
            return np.array(self.coder.encode(text, add_special_tokens=False).ids, self.kind)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE)
            to = cut.start() if cut else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[at:to]), self.kind))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items (by index) of each of so many windows, with sums as near as differencing gets.

    A partial partition is its non-empty windows' sums in ascending order (the others are empty). The two with the widest spread
    are merged, the largest sums of one meeting the smallest of the other, until one is left."""
    heap = [(-n, k, [n], [[k]]) for k, n in enumerate(lengths)]
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        if len(a) < len(b):
            a, ia, b, ib = b, ib, a, ia
        met = max(0, len(a) + len(b) - windows)  # so many of a's smallest meet b's, the smallest the largest
        rest = len(b) - met
        sums = a[met:] + [x + y for x, y in zip(a, reversed(b[rest:]), strict=False)] + b[:rest]
        items = ia[met:] + [x + y for x, y in zip(ia, reversed(ib[rest:]), strict=False)] + ib[:rest]
        order = sorted(range(len(sums)), key=sums.__getitem__)
        sums = [sums[k] for k in order]
        items = [items[k] for k in order]
        low = sums[0] if len(sums) == windows else 0
        heapq.heappush(heap, (low - sums[-1], at, sums, items))
        at += 1
    return heap[0][3] if heap else []


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows (lists of indices) of at most `capacity`: their number rises until differencing exceeds it nowhere."""
    if not lengths:
        return []
    windows = -(-sum(lengths) // capacity)
    while True:
        found = differencing(lengths, windows)
        over = sum(max(0, sum(lengths[k] for k in w) - capacity) for w in found)
        if not over:
            return found
        windows += max(1, over // (2 * capacity))


def close_windows(windows: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The windows' items as (index, start, length), in as few windows as the sum needs: the least filled ones are dissolved, and
    their items cut to fill what room the others have."""
    windows = sorted(windows, key=lambda w: sum(lengths[k] for k in w))
    spare = len(windows) - -(-sum(lengths) // capacity)
    loose = [(k, 0, lengths[k]) for w in windows[:spare] for k in w]
    closed = []
    for w in windows[spare:]:
        own = [(k, 0, lengths[k]) for k in w]
        room = capacity - sum(lengths[k] for k in w)
        while room and loose:
            k, at, n = loose.pop()
            own.append((k, at, min(n, room)))
            if n > room:
                loose.append((k, at + room, n - room))
            room -= min(n, room)
        closed.append(own)
    return closed


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    group: int = 512,
    windows: int = 75,
    full_group: int = 4096,
    copies: int = 64,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents in sequences of
    at most `capacity` tokens.

    A document is its text's ids by the tokenizer's file (`ranks` and `pattern`: the same vocabulary, see TextIds) and end_id (so a null or empty text is one token). It is cut
    every `capacity` tokens. Whole cuts are sequences of their own. The ends, with their ids, are dealt by hash into groups of about `group`
    ends or of `windows` windows, whichever is more; each is packed by differencing, whose windows rise in number while one exceeds the
    capacity. Then the windows beyond what the group's tokens need are dissolved, their ends cut to fill the others (close_windows), so a group
    pads less than one sequence.

    Texts are read once, by the tasks that scan them; what is shuffled is their ends' ids and numbers. Rows that repeat a document are separate
    documents with equal pieces, dealt in bundles of `copies`, and everything depends on the rows alone, not on how they lie. A null
    key passes through; other columns are not read; an empty table gives an empty result."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextIds(tokenizer, ranks, pattern)
        for batch, raw in pieces(batches, "text"):
            rows, ends = [], []
            for at, x in enumerate(raw):
                ids = np.append(coder.of(x.decode("utf-8")), np.array(end_id, coder.kind))
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    rows.append((at, k, len(part), zlib.crc32(part.astype("<u4")), len(ids)))
                    ends.append(part.tobytes() if len(part) < capacity else None)
            at, *columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), *map(pa.array, columns), pa.array(ends, pa.binary())],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    parts = settle(docs.mapInArrow(cut, f"key {kind}, {PIECES}, ids binary"))
    is_end = F.col("length") < capacity
    sizes = parts.agg(F.count_if(~is_end).alias("full"), F.count_if(is_end).alias("ends"), F.sum(F.when(is_end, F.col("length"))).alias("tokens")).first()

    def dealt(rows: DataFrame, groups: int) -> DataFrame:
        """Equal rows as bundles, each with its number of rows and its group."""
        counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
        bundles = counted.withColumn("_bundle", F.explode(F.expr(f"sequence(0, (_n - 1) div {copies})")))
        own = F.least(F.lit(copies), F.col("_n") - F.col("_bundle") * copies).cast("int")
        return bundles.withColumns({"_n": own, "_group": F.pmod(F.xxhash64("key", "start", "ids_crc32", "_bundle"), F.lit(max(1, groups)))})

    full = dealt(parts.filter(~is_end).drop("ids"), round(sizes["full"] / full_group))
    full = full.withColumn("_copy", F.explode(F.expr("sequence(1, _n)")))
    number = F.row_number().over(Window.partitionBy("_group").orderBy("key", "start", "ids_crc32", "_bundle", "_copy"))
    # Groups of ends have even numbers, those of whole cuts odd ones.
    full = full.withColumns({"sequence_id": F.expr("shiftleft(2 * _group + 1, 32)") + number, "offset": F.lit(0).cast("long")})

    def part_crc(raw: bytes, length: int, at: int, n: int) -> int:
        whole = np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4")
        return zlib.crc32(whole[at : at + n].astype("<u4"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "start", "ids_crc32", "_bundle"], kind="stable")
        frame = frame.loc[frame.index.repeat(frame["_n"])].reset_index(drop=True)
        lengths, crcs, ids = frame["length"].tolist(), frame["ids_crc32"].tolist(), frame["ids"].tolist()
        rows = []
        for k, own in enumerate(close_windows(pack_lengths(lengths, capacity), lengths, capacity)):
            offset = 0
            for i, at, n in own:
                rows.append((i, at, n, crcs[i] if n == lengths[i] else part_crc(ids[i], lengths[i], at, n), k, offset))
                offset += n
        i, at, n, crc, k, offset = np.array(rows, np.int64).T
        out = frame.iloc[i][["key", "start", "doc_tokens"]].reset_index(drop=True)
        return out.assign(start=out["start"] + at, length=n, ids_crc32=crc, sequence_id=(2 * int(frame["_group"].iloc[0]) << 32) + k, offset=offset)

    groups = min(round(sizes["ends"] / group), (sizes["tokens"] or 0) // (windows * capacity))
    packed = dealt(parts.filter(is_end), groups).groupBy("_group").applyInPandas(pack, f"key {kind}, {PIECES}, sequence_id long, offset long")
    return packed.unionByName(full.select(packed.columns)).withColumnRenamed("key", key)
