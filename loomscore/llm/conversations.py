"""Repair of damaged conversations: the cheapest edits to a well-formed course of roles, found once for each shared prefix.

A row is a symbol: its role (system, user, assistant, other) and its fault. Rows are sorted over the whole table and cut into segments, runs
of rows of one conversation that lie in one partition; nearly all conversations are one segment, a huge one is many. The segments' signatures
(their symbols) are sorted, so a partition walks them as a prefix trie: each trie node holds one layer of the dynamic programme, worked out once
from its parent's, and a terminal node answers for all segments that end there. A segment of a longer conversation is answered for
each state it may begin in, and its conversation puts the answers of its segments together.

Well-formed are the role initials `(s?(ua)+)?`, an automaton of four states: nothing yet, after s, after u, after a."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, crc_of, crc_sql, settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The automaton: (state, initial) to state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: A segment's most rows and characters of text.
ROWS, CHARS = 4096, 1 << 24

Best = tuple[int, str]
Layer = tuple[Best | None, ...]


def inserted(layer: list[Best | None]) -> Layer:
    """The layer after any inserts: three reach every state, more come back to one."""
    for _ in range(3):
        for (state, initial), to in NEXT.items():
            if initial != "s" and layer[state] is not None:
                cost, audit = layer[state]
                option = (cost + INSERT, audit + "I")
                if layer[to] is None or option < layer[to]:
                    layer[to] = option
    return tuple(layer)


def opened(state: int, first: bool) -> Layer:
    """The layer before a segment that begins in this state; only before the first row may inserts stand, later ones belong to the row before."""
    layer: list[Best | None] = [None] * 4
    layer[state] = (0, "")
    return inserted(layer) if first else tuple(layer)


def taken(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row. A symbol is the role's initial (`o`: none of s, u, a), upper case if the row is truncated, or `d` if it must go.

    Of equal costs the least audit wins. No audit of a layer begins with another one of the same cost, so the least stays the least."""
    found: list[Best | None] = [None] * 4
    extra = TRUNCATED if symbol.isupper() else 0
    role = symbol.lower()

    def offer(to: int, option: Best) -> None:
        if found[to] is None or option < found[to]:
            found[to] = option

    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        offer(state, (cost + DELETE, audit + "D"))
        if role == "d":
            continue
        if (state, role) in NEXT:
            offer(NEXT[state, role], (cost + KEEP + extra, audit + "K"))
        for initial in "ua":
            if (state, initial) in NEXT:
                offer(NEXT[state, initial], (cost + REROLE + extra, audit + "R"))
    return inserted(found)


def walk(signatures: Iterable[tuple[bool, str]]) -> Iterator[list[Layer]]:
    """Of each (whole, signature), in sorted order: its last layer for each state in which it may begin (only 0, if it is a whole conversation).

    What is held is one path of the trie: the layers of the last signature's prefixes."""
    kind, last = None, ""
    path: list[list[Layer]] = []
    for whole, signature in signatures:
        if whole != kind:
            kind, last = whole, ""
            path = [[opened(0, True)] if whole else [opened(0, True), *(opened(s, False) for s in range(4))]]
        shared = 0
        while shared < min(len(last), len(signature)) and last[shared] == signature[shared]:
            shared += 1
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            path.append([taken(layer, symbol) for layer in path[-1]])
        last = signature
        yield path[-1]


def repair(symbols: str) -> Best:
    """The cheapest edits of one conversation: their cost and audit."""
    last = next(iter(walk([(True, symbols)])))[0]
    return min(last[s] for s in FINAL if last[s] is not None)


def apply_edits(audit: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], int]:
    """The repaired rows as `role:text`, and the state after them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text, initial = roles[at], texts[at], roles[at][:1]
        else:
            initial = "a" if state == 2 else "u"
            role, text = NAMES[initial], "" if edit == "I" else texts[at]
        state = NEXT[state, initial]
        out.append(f"{role}:{text}")
        at += edit != "I"
    return out, state


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): the conversations with the planted faults; a dropped row stays as a mark that its conversation exists.

    A null reads as one space; turn and conv_id themselves stay null."""
    blank = F.lit(" ")
    h = crc_of(*(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
        (h == 0).alias("gone"),
    )


@dataclass
class Run:
    """A segment as its rows come, in order."""

    conv: str | None
    symbols: list[str] = field(default_factory=list)
    digests: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)
    first: int | None = None
    last: int | None = None
    chars: int = 0

    def __post_init__(self):
        self.seen: set[str] = set()

    def add(self, turn: str | None, role: str, text: str, fault: str, digest: str) -> None:
        repeated = digest in self.seen
        self.seen.add(digest)
        self.digests.append("" if repeated or fault == "blank" else digest)
        if self.roles:
            self.counts["illegal"] += self.roles[-1][:1] + role[:1] not in LEGAL
        fault = fault if fault == "blank" or not repeated else "duplicate"
        if fault:
            self.counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.symbols.append("d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None:
            at = int(turn)
            self.counts["turns"] += at != self.last
            self.first = at if self.first is None else self.first
            self.last = at


LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
SEGMENT = (
    "id string, part int, seg int, whole boolean, symbols string, digests array<string>, roles array<string>, texts array<string>, "
    "first long, last long, blank long, duplicate long, truncated long, illegal long, turns long"
)


def segments(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """Rows of (id, turn, role, text, copy, gone) as segments, sorted by turn (nulls first), then role and the text's digest.

    (part, seg) orders a conversation's segments; `whole` marks one that certainly is its whole conversation."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "blank").when(F.substring(end, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    order = [F.col(c).asc_nulls_first() for c in ("id", "turn", "role", "digest", "copy")]
    dealt = rows.withColumns({"fault": fault, "digest": digest}).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ready = TaskContext.get().partitionId(), []
        seg, run, inside = 0, None, False  # inside: the conversation began in this partition and has one segment so far

        def close(whole: bool) -> None:
            nonlocal seg
            digests = [] if whole else run.digests
            ready.append((run.conv, part, seg, whole, "".join(run.symbols), digests, run.roles, run.texts, run.first, run.last, *(run.counts[c] for c in COUNTS)))
            seg += 1

        def made() -> pd.DataFrame:
            frame = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*ready, strict=True), strict=True)})
            ready.clear()
            return frame

        for frame in frames:
            for conv, turn, role, text, gone, what, own in frame.itertuples(index=False):
                if run is None:
                    run = Run(conv)
                elif conv != run.conv:
                    close(inside)
                    inside, run = True, Run(conv)
                elif len(run.texts) >= most_rows or run.chars >= most_chars:
                    close(False)
                    inside, run = False, Run(conv)
                if not gone:
                    run.add(turn, role, text, what, own)
            if ready:
                yield made()
        if run is not None:
            close(False)  # the next partition may hold the rest
            yield made()

    names = [c.strip().split(" ")[0] for c in SEGMENT.split(",")]
    return dealt.select("id", F.col("turn").cast("string"), "role", "text", "gone", "fault", "digest").mapInPandas(cut, SEGMENT)


def later_copies(parts: DataFrame) -> DataFrame:
    """Of segments that may be parts of a conversation: (part, seg, again), the places of rows that repeat one of an earlier segment.

    A segment names a digest once, so one text that fills a conversation is one row for each of its segments."""
    at = F.struct("part", "seg")
    named = parts.select("id", "part", "seg", F.posexplode("digests").alias("place", "digest")).filter("digest <> ''")
    first = named.groupBy("id", "digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("id").alias("c"), F.col("digest").alias("d"), "first")
    again = named.join(first, F.col("id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).filter(at > F.col("first"))
    return again.groupBy("part", "seg").agg(F.collect_list("place").alias("again"))


def mark_copies(parts: DataFrame) -> DataFrame:
    """The segments with what later_copies finds put into symbols and counts."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, places in enumerate(frame["again"]):
                if places is not None:
                    own = list(frame.at[k, "symbols"])
                    frame.at[k, "truncated"] -= sum(own[p].isupper() for p in places)
                    frame.at[k, "duplicate"] += len(places)
                    for p in places:
                        own[p] = "d"
                    frame.at[k, "symbols"] = "".join(own)
            yield frame.drop(columns="again")

    slim = parts.drop("texts", "digests")
    return slim.join(later_copies(parts), ["part", "seg"], "left").mapInPandas(mark, slim.schema)


CELLS = "array<struct<before: int, after: int, cost: long, audit: string>>"


def answers(signed: DataFrame) -> DataFrame:
    """(part, seg, cells): of each segment (part, seg, whole, symbols), for each state before and after it, cost and audit.

    Equal signatures of one partition are one trie node; a signature that very many segments have may lie in several partitions.
    `before` is -1 for a conversation's start, and a whole conversation has one cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ready, before, cells = [], [], None, []

        def signatures() -> Iterator[tuple[bool, str]]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    held.append(row)
                    yield row.whole, row.symbols

        for layers in walk(signatures()):
            row = held.pop()
            if before != (row.whole, row.symbols):  # else the terminal node answers again
                before = (row.whole, row.symbols)
                cells = [(b, s, *best) for b, layer in zip((-1, 0, 1, 2, 3), layers, strict=False) for s, best in enumerate(layer) if best is not None]
                if row.whole:
                    cells = [min((c for c in cells if c[1] in FINAL), key=lambda c: c[2:])]
            ready.append((row.part, row.seg, cells))
            if len(ready) == 1000:
                yield pd.DataFrame(ready, columns=["part", "seg", "cells"])
                ready.clear()
        if ready:
            yield pd.DataFrame(ready, columns=["part", "seg", "cells"])

    order = ["whole", "symbols", "part", "seg"]
    dealt = signed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, f"part int, seg int, cells {CELLS}")


def by_conversation(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, Iterator]]:
    """(id, its rows) of sorted rows, each read as it comes."""
    rows = (row for frame in frames for row in frame.itertuples(index=False))
    for conv, own in itertools.groupby(rows, key=lambda row: row.id):
        yield conv, own


def joined(parts: DataFrame) -> DataFrame:
    """The answers (id, part, seg, symbols, cells) of each conversation's segments put together: (part, seg, edits, cost, audit), the last two on its first segment.

    A conversation's audit is one value of the result, so it is held whole; its segments come one after another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in by_conversation(frames):
            layer: dict[int, Best] = {-1: (0, "")}
            sizes = []
            for row in rows:
                sizes.append((row.part, row.seg, len(row.symbols)))
                after: dict[int, Best] = {}
                for c in row.cells:
                    if c["before"] in layer:
                        cost, audit = layer[c["before"]]
                        option = (cost + c["cost"], audit + c["audit"])
                        if c["after"] not in after or option < after[c["after"]]:
                            after[c["after"]] = option
                layer = after
            cost, audit = min(layer[s] for s in FINAL if s in layer)
            ready, at = [], 0
            for part, seg, n in sizes:  # a segment's edits: its rows' and the inserts after them, and before the first row
                to = at
                while to < len(audit) and (n or audit[to] == "I"):
                    n -= audit[to] != "I"
                    to += 1
                ready.append((part, seg, audit[at:to], None if ready else cost, None if ready else audit))
                at = to
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("part", "seg", "edits", "cost", "audit"), zip(*ready, strict=True), strict=True)})

    dealt = parts.repartition("id").sortWithinPartitions("id", "part", "seg")
    return dealt.mapInPandas(run, "part int, seg int, edits string, cost long, audit string")


RESULT = "id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(parts: DataFrame) -> DataFrame:
    """Conversations of segments that come in order with their edits: one row each. Texts are hashed as they come."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = []
        for conv, rows in by_conversation(frames):
            total, digest, state, sep = Counter(), hashlib.sha256(), 0, b""
            cost = audit = first = last = role = None
            for row in rows:
                if audit is None:
                    cost, audit = row.cost, row.audit
                for c in COUNTS:
                    total[c] += getattr(row, c)
                if len(row.roles):
                    total["illegal"] += role is not None and role[:1] + row.roles[0][:1] not in LEGAL
                    role = row.roles[-1]
                if row.first is not None:
                    total["turns"] -= int(row.first) == last
                    first, last = int(row.first) if first is None else first, int(row.last)
                lines, state = apply_edits(row.edits, row.roles, row.texts, state)
                for line in lines:
                    digest.update(sep + line.encode())
                    sep = b"\n"
            gaps = 0 if first is None else last - first + 1 - total["turns"]
            ready.append((conv, gaps, *(total[c] for c in COUNTS[:4]), cost, audit, digest.hexdigest()))
            if len(ready) == 1000:
                yield pd.DataFrame(ready, columns=names)
                ready.clear()
        if ready:
            yield pd.DataFrame(ready, columns=names)

    names = [c.strip().split(" ")[0] for c in RESULT.split(",")]
    return parts.withColumns({c: F.col(c).cast("string") for c in ("first", "last")}).mapInPandas(run, RESULT)


def repair_conversations(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, copy, gone),
    one row for each conv_id.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (its last
    visible character is none of `.!?`). Repair keeps rows at no cost, gives one the role user or assistant (2), deletes one (3, which blank and
    duplicate rows must be), inserts empty ones (2); a truncated row that stays adds 1. The audit names the cheapest edits by their initials, the
    ASCII-least of equal ones. gaps are turns missing between the least and the greatest.

    A row that is `gone` only says that its conversation exists; one that has no other rows has zeros, an empty audit and the hash of nothing.
    Rows without a turn come first, rows of one turn stand by role and the digest of their text. Null conv_ids are one conversation, null roles
    and texts are one space. Repeated rows are duplicates. Extra columns are not read. An empty table gives an empty result.

    Texts are shuffled twice: to be sorted, and to meet their edits. A conversation of any size is many segments, each worked out on its own."""
    kind = rows.schema["conv_id"].dataType
    blank = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")),
        "copy",
        "gone",
    )
    parts = settle(segments(rows, most_rows, most_chars))
    place = ["part", "seg"]
    open_parts, whole = parts.filter("NOT whole"), parts.filter("whole")
    marked = settle(mark_copies(open_parts))
    signed = whole.select("whole", "symbols", *place).union(marked.select("whole", "symbols", *place))
    found = settle(answers(signed))
    at_once = found.select(*place, F.element_at("cells", 1).alias("best")).select(*place, F.col("best.audit").alias("edits"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    texts = whole.drop("digests", "symbols").join(at_once, place)
    in_parts = settle(joined(marked.select("id", "symbols", *place).join(found, place)))
    open_texts = open_parts.select("texts", *place).join(marked.drop("symbols"), place).join(in_parts, place)
    one = repaired(texts).union(repaired(open_texts.repartition("id").sortWithinPartitions("id", *place)))
    return one.select(F.col("id").cast(kind).alias("conv_id"), *one.columns[1:])


def oracle() -> str:
    """The same of the conversations, row by row: of each conversation the cheapest way into each state, with its audit and repaired text."""

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def step(state: str, cost: str, edit: str, out: str = "''") -> str:
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', 'out': {state}.out || {out}}}"

    never = "{'cost': 1000000000, 'audit': '', 'out': ''}"
    line = "chr(10) || role || ':' || text"

    def into(to: str, initial: str, ways: tuple[int, ...]) -> str:
        kept = [f"CASE WHEN sym <> 'd' AND role[1] = '{initial}' THEN {step(f'l{w}', 'extra', 'K', line)} ELSE {never} END" for w in ways]
        name = NAMES.get(initial)
        other = [f"CASE WHEN sym <> 'd' THEN {step(f'l{w}', 'extra + 2', 'R', f"chr(10) || '{name}:' || text")} ELSE {never} END" for w in ways if name]
        return best(step(to, "3", "D"), *kept, *other)

    user, reply = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return f"""
WITH RECURSIVE h AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h
    FROM conversations
), d AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM h WHERE h <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM d
), f AS (
    SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o
), r AS (SELECT conv_id, k, role, text, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE 'k' END AS sym, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM f
), dp AS (
    SELECT conv_id, 0::BIGINT AS k, {{'cost': 0, 'audit': '', 'out': ''}} AS l0, {never} AS l1, {{'cost': 2, 'audit': 'I', 'out': {user}}} AS l2, {{'cost': 4, 'audit': 'II', 'out': {user} || {reply}}} AS l3
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, k, n0, n1, m2, {best("n3", step("m2", "2", "I", reply))} FROM (
        SELECT *, {best("n2", *(step(n, "2", "I", user) for n in ("n0", "n1", "n3")))} AS m2 FROM (
            SELECT dp.conv_id, r.k, {step("l0", "3", "D")} AS n0, {into("l1", "s", (0,))} AS n1, {into("l2", "u", (0, 1, 3))} AS n2, {into("l3", "a", (2,))} AS n3
            FROM dp JOIN r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = dp.k + 1))
), ends AS (SELECT conv_id, arg_max({best("l0", "l3")}, k) AS top FROM dp GROUP BY conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id)
SELECT ends.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
       CAST(top.cost AS BIGINT) AS cost, top.audit AS audit, sha256(substr(top.out, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
"""
