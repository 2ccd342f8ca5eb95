"""Spelling variants, conversation repair and prefix counts against plain versions, and on odd rows."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from loomscore.llm import conversations, prefix_tokens, queries, spelling
from tests import oracle

MODEL = "piece_bpe_32k.model"
LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


# --- spelling variants


def grouped(counts, ratio=10):
    """Every word's neighbours by taking one code point out."""
    less, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), own in less.items():
        for a in own:
            near[a] |= own - {a}
            if rest in counts:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def groups_of(spark, counts, **how):
    words = spark.createDataFrame([(*x, "x", "y") for x in counts.items()], "word string, n long, bucket string, best string")
    return {r.word: tuple(r)[1:] for r in spelling.group_spellings(words, **how).collect()}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=7), max_size=40))
def test_near_pairs(words):
    """One bucket: all pairs at distance one, each once."""
    words = sorted(words)
    chars, size = spelling.code_points(spelling.pa.array(words, spelling.pa.string()))
    i, j = spelling.near_pairs(np.zeros(len(words), int), chars, size)
    got = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(i, j, strict=True))
    want = grouped(dict.fromkeys(words, 1))
    assert len(got) == len(set(got)) and 2 * len(got) == sum(n for *_, n, _ in want.values())
    assert all(spelling_distance(a, b) == 1 for a, b in got)


def spelling_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))  # noqa: B023
    return row[-1]


@pytest.mark.parametrize("cells", [1, 200, 1 << 20])
def test_spellings_whatever_the_buckets(spark, cells):
    """Words that share nearly everything, so that buckets are halved down to two characters; long ones; ties; chains of forms."""
    r = np.random.default_rng(3)
    counts = {"common" + "".join(x): int(n) for x, n in zip(r.choice(list("abcdé"), (600, 4)), r.integers(1, 400, 600), strict=True)}
    counts |= {"x" * 5000: 9, "x" * 5001: 900, "x" * 2500 + "y" + "x" * 2499: 90_000, "ab": 2, "abc": 50, "ac": 50}
    assert groups_of(spark, counts, cells=cells) == grouped({w: n for w, n in counts.items()})


def test_spellings_of_nothing(spark):
    assert groups_of(spark, {}) == {}
    assert groups_of(spark, {"alonely": 3}) == {"alonely": (None, "alonely", 3, 0, None)}


def test_vocabulary_of_odd_rows(spark):
    text = "Straße naïveté NAÏVETÉ ordinary\tOrdinary-ordinary x1 Ordinaryordinary"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "z" * 300_000 + " " + "z" * 300_000)]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, key string, run string, h string")
    counts = defaultdict(int)
    for key, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode()) if key is not None else zlib.crc32(f":{run}".encode())
            at = h % len(run)
            run = run[:at] + run[at + 1 :] if h % 31 == 0 else run
            counts[run] += len(run) >= 7
    want = {w: n for w, n in counts.items() if n >= 2}
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == want
    assert spelling.vocabulary(docs.limit(0)).collect() == []


# --- conversations


def repaired(rows):
    """By trying edits in the order of their cost and audit."""
    rows = [r for r in rows if not r[4]]
    seen, faults = set(), []
    for _, role, text, *_ in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, k, out = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in out)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if (k, roles[-1:]) in done:
            continue
        done.add((k, roles[-1:]))
        options = [(2, "I", k, (name, "")) for name in ("user", "assistant")]
        if k < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, out))
            _, role, text, *_ = rows[k]
            if faults[k] in ("", "truncated"):
                extra = faults[k] == "truncated"
                options += [(extra, "K", k + 1, (role, text))] + [(2 + extra, "R", k + 1, (name, text)) for name in ("user", "assistant")]
        for more, edit, at, row in options:
            if row[0][:1] and re.fullmatch("s?(ua)*u?", roles + row[0][:1]):
                heapq.heappush(heap, (cost + more, audit + edit, at, (*out, row)))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def repairs(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id string, turn long, role string, text string, copy int, gone boolean, id string, part string, symbols string")
    return {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(df, **how).collect()}


TEXTS = st.sampled_from(["Yes.", "no", "Why?  ", " \n", "", "é!", "a\nb"])
ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", "s", "u"])


@pytest.mark.parametrize("most_rows", [1, 3, 4096])
def test_repairs_whatever_the_segments(spark, most_rows):
    r = np.random.default_rng(most_rows)
    rows = []
    for c in range(150):
        for turn in range(int(r.integers(0, 9))):
            row = (str(c), int(turn + r.integers(0, 3)), str(r.choice(["system", "user", "assistant", "tool", ""])), str(r.choice(["Yes.", "no", "Why?  ", " \n", "", "é!", "a\nb"])))
            rows += [(*row, k, bool(r.random() < 0.1)) for k in range(1 + (r.random() < 0.1))]
        rows.append((str(c), None, "user", f"no turn {c}.", 0, c % 9 > 0))
    rows += [(None, 1, "user", "no key.", 0, False), (None, 2, "assistant", "none", 0, False), ("long", 1, "user", "é" * 2_000_000 + ".", 0, False)]
    rows += [("huge", k, ("user", "assistant")[k % 2], f"{k % 50}.", 0, False) for k in range(400)]
    own = defaultdict(list)
    # Rows of one turn stand by role and digest.
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest(), x[4])):
        own[row[0]].append(row[1:])
    got = repairs(spark, rows, most_rows=most_rows, most_chars=1 << 20)
    for key, plain in own.items():
        assert got[key] == repaired(plain), key
    assert set(got) == set(own)


def test_repairs_of_nothing(spark):
    assert repairs(spark, []) == {}
    assert repairs(spark, [("a", 1, "user", "x", 0, True)]) == {"a": (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_cheapest_edits(rows):
    plain = repaired([(k, *r, 0, False) for k, r in enumerate(rows)])
    run = conversations.Run("c")
    for k, (role, text) in enumerate(rows):
        end = text.rstrip()
        run.add(str(k), role, text, "blank" if not end else "" if end[-1] in ".!?" else "truncated", f"{role}\0{text}")
    cost, audit = conversations.repair("".join(run.symbols))
    lines, _ = conversations.apply_edits(audit, run.roles, run.texts)
    assert (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()) == plain[5:]


def test_layers_are_worked_out_once(monkeypatch):
    """As many layers as the trie has nodes."""
    made = []
    one = conversations.taken
    monkeypatch.setattr(conversations, "taken", lambda layer, symbol: made.append(symbol) or one(layer, symbol))
    signatures = sorted({"uaua", "uau", "uaud", "sua", "suaU", "uaua", ""})
    assert len(list(conversations.walk((True, s) for s in signatures))) == len(signatures)
    assert len(made) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


# --- token counts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("  ▁aehtnsTE.,-=/_0190éü漢\n\t\x00ıß") + ["the ", "ing", "<s>", "</s>", "<0x0A>", "<unk>"]), max_size=60).map("".join), st.sampled_from([1, 8, 1 << 20]))
def test_every_prefix(text, slice_size):
    before, prefix_tokens.SLICE = prefix_tokens.SLICE, slice_size
    try:
        steps = prefix_tokens.counter(MODEL).steps(text)
    finally:
        prefix_tokens.SLICE = before
    assert np.cumsum(steps).tolist() == [len(LIBRARY.encode(text[:k])) for k in range(1, len(text) + 1)]


def test_prefix_counts_of_odd_rows(spark):
    long = "word and spaces    " * 120_000
    rows = [(1, None), (2, ""), (3, "One day."), (3, "One day."), (None, "no key"), (4, long), (5, "x" * 70_000), (6, " "), (7, "漢" * 300)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, steps string")
    counted = prefix_tokens.prefix_counts(docs, MODEL)
    asked = counted.withColumns(
        {"at_3": prefix_tokens.tokens_at(3), "past": prefix_tokens.tokens_at(10**9), "none": prefix_tokens.tokens_at(-1), "within": prefix_tokens.prefix_within(5), "empty": prefix_tokens.prefix_within(0)}
    )
    got = asked.drop("steps").collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_chars, r.n_tokens)) for r in got) == sorted(str((k, len((t or "").encode()), len(t or ""), len(LIBRARY.encode(t or "")))) for k, t in rows)
    for r in got:
        text = next(t or "" for k, t in rows if k == r.doc_id)
        assert (r.at_3, r.past, r.none, r.empty) == (len(LIBRARY.encode(text[:3])), r.n_tokens, None, 0)
        assert len(LIBRARY.encode(text[: r.within])) <= 5 and all(len(LIBRARY.encode(text[:k])) > 5 for k in range(r.within + 1, min(len(text), r.within + 40) + 1))
    assert prefix_tokens.prefix_counts(docs.limit(0), MODEL).collect() == []


def test_op13(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_counts(spark, oracle.DATA).collect()}
    want = {k: (len(t.encode()), len(LIBRARY.encode(t))) for k, t in docs.items()}
    assert got == {k: (*v, v[1] > 4096) for k, v in want.items()}


def test_a_model_that_changes_texts_is_refused(tmp_path):
    raw = open(public_tokenizers.path(MODEL), "rb").read()
    (tmp_path / "m.model").write_bytes(raw + b"\x1a\x02\x20\x01")  # it takes out extra spaces
    with pytest.raises(ValueError):
        prefix_tokens.PrefixCounter(str(tmp_path / "m.model"))


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair"])
def test_against_sql_on_more_rows(spark, name):
    d = "/root/testdata/sf0.01"
    oracle.check(queries.QUERIES[name](spark, d).select(F.expr("*")), queries.ORACLE_SQL[name], oracle.connect(d))
