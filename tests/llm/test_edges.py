"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and the small parts against brute force."""

from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomscore.llm import attention, jaccard, licenses, line_dedup, mixing, onebit, packing, queries, repetition, sharding, warc
from loomscore.llm.common import connected_components
from loomscore.llm.wordhash import shingle_sets
from tests.llm import brute

LONG = "\n".join(" ".join(f"w{(k * k) % 9973}" for k in range(i, i + 40)) for i in range(0, 40_000, 40))
CLASH = ["key", "node", "tokens", "n", "cell", "shard", "slot", "epoch", "n_tokens", "kept", "score", "_key", "_drop", "removed_lines", "path", "size", "domain"]
ROWS = [
    (1, None, "en", "s1"),
    (2, "", "en", None),
    (3, " \n\t ", None, "s1"),
    (4, "one two three four five six seven eight nine ten eleven", "en", "s1"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "s2"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "s2"),
    (6, LONG, "de", "s1"),
    (7, LONG + " tail", "de", "s3"),
    (8, "<|endoftext|> naïve 漢字 \x00  x", "de", "s3"),
    (None, "a text without a key that has some words in it for good measure", "en", "s1"),
    (9, "short", "en", "s1"),
    (10, "SHORT", "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in ROWS], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))
    return made


OPERATORS = {
    "op1": lambda d: line_dedup.drop_spread_lines(d, min_sites=2),
    "op2": repetition.quality_rules,
    "op3": lambda d: mixing.mix_sources(queries.with_domain(d), queries.LEVELS, queries.WEIGHTS),
    "op5": lambda d: attention.score_quality(d, d.sparkSession.createDataFrame([(4, 1), (6, 0), (9, None), (None, 1)], "doc_id long, quality int")),
    "op6": lambda d: packing.pack_documents(d, *queries.tokenizer_files()),
    "op7": sharding.shard_documents,
    "op9": jaccard.jaccard_components,
    "op10": licenses.scan_licenses,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    got = OPERATORS[name](docs).collect()
    keys = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
    want = sorted(-1 if r[0] is None else r[0] for r in ROWS)
    if name == "op3":
        rows = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in ROWS]
        for d in rows:
            d["domain"] = str(int(d["source"][1:]) % 4 if d["source"] else 0)
        wanted = brute.mixed([{**d, "doc_id": "" if d["doc_id"] is None else d["doc_id"]} for d in rows], queries.LEVELS, queries.WEIGHTS, epochs=2)
        assert {("" if r.doc_id is None else r.doc_id, r.epoch) for r in got} == wanted
    elif name == "op6":
        assert set(keys) == set(want)
        whole = {}
        for r in got:
            whole.setdefault(r.doc_id, []).append(r)
        assert [(r.start, r.length) for r in whole[1]] == [(0, 1)]
        assert len(whole[5]) == 2
        assert sum(r.length for r in whole[6]) == whole[6][0].doc_tokens > 40_000
    elif name == "op9":
        assert keys == want
        parts = sorted(tuple(r) for r in got if r.doc_id is not None)
        assert parts == sorted(brute.components([r[:2] for r in ROWS if r[0] is not None]))
        assert [(r.n_shingles > 5, r.component_id) for r in got if r.doc_id is None] == [(True, None)]
    else:
        assert keys == want
    if name == "op2":
        judged = {r.doc_id: r for r in got}
        for key, text, *_ in ROWS[:6]:
            assert {k: judged[key][k] for k in brute.quality(text)} == brute.quality(text)
        assert judged[8].n_words == len(brute.words(ROWS[8][1]))
    if name == "op1":
        texts = {r.doc_id: r.text for r in got}
        assert texts[1] is None and texts[2] == ""
    if name == "op7":
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixing_redistributes_to_siblings_first(spark):
    weights = ({"a": 1, "b": 1}, {}, {})
    rows = [(k, "w " * 10, "a", "x", "s") for k in range(10)] + [(100 + k, "w " * 10, "a", "y", "s") for k in range(50)] + [(200 + k, "w " * 10, "b", "x", "s") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    got = {(r.doc_id, r.epoch) for r in mixing.mix_sources(df, queries.LEVELS, weights, max_epochs=1).collect()}
    docs = [dict(zip(df.columns, r, strict=True)) for r in rows]
    assert got == brute.mixed(docs, queries.LEVELS, weights)
    # 960 of 1200 tokens: 480 for each domain; a/x can give 100 of its 240, and a/y takes its sibling's shortage.
    assert (sum(k < 100 for k, _ in got), sum(100 <= k < 200 for k, _ in got), sum(k >= 200 for k, _ in got)) == (10, 38, 48)


def test_mixing_of_equal_keys(spark):
    """A leaf with very many rows of one null key, which stand at one place of the order, and rows without tokens."""
    rows = [(None, "w w w", "a", "x", "s")] * 300 + [(k, "w " * (k % 7), "a", "x", "s") for k in range(200)] + [(900 + k, "", "b", "x", "s") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    docs = [{**dict(zip(df.columns, r, strict=True)), "doc_id": "" if r[0] is None else r[0]} for r in rows]
    for epochs, percent in ((1, 80), (2, 150), (1, 20)):
        got = mixing.mix_sources(df, queries.LEVELS, ({}, {}, {}), max_epochs=epochs, percent=percent).collect()
        assert {("" if r.doc_id is None else r.doc_id, r.epoch) for r in got} == brute.mixed(docs, queries.LEVELS, ({}, {}, {}), percent=percent, epochs=epochs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5))
def test_suffix_repeats(texts):
    ws = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    want = [k for t in texts for k in brute.longest_repeats(t)]
    assert repetition.suffix_repeats(ws, owner, end).tolist() == want
    before, repetition.MANY = repetition.MANY, 0
    try:
        assert repetition.suffix_repeats(ws, owner, end).tolist() == want  # Kasai's scan
    finally:
        repetition.MANY = before


def test_what_only_the_suffix_array_rejects(spark):
    """A long text with one passage of 25 words twice, and a text made of phrases of four words; each passes the base rule."""
    plain = [f"w{k}" for k in range(400)]
    phrases = [x for k in range(60) for x in [*f"p{k % 12} q{k % 12} r{k % 12} s{k % 12}".split(), f"u{k}"]]
    rows = [(1, " ".join(plain)), (2, " ".join(plain[:300] + plain[10:35])), (3, " ".join(plain[:300] + plain[10:25])), (4, " ".join(phrases))]
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k: r.kept for k, r in got.items()} == {1: True, 2: False, 3: True, 4: False}
    assert (got[2].longest_repeat, got[3].longest_repeat, got[4].longest_repeat) == (25, 15, 4)
    assert all(got[k][c] == v for k, text in rows for c, v in brute.quality(text).items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbÀ \n\t\x0b ", max_size=60), min_size=1, max_size=6))
def test_shingle_sets(texts):
    got = [len(s) for s in shingle_sets([t.encode() for t in texts], 5)]
    assert got == [len(brute.shingles(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_differencing(lengths):
    windows = packing.pack_lengths(lengths, 100)
    assert sorted(k for w in windows for k in w) == list(range(len(lengths)))
    assert all(0 < sum(lengths[k] for k in w) <= 100 for w in windows if w)


def test_differencing_balances():
    assert sorted(sum([8, 7, 6, 5, 4][k] for k in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ09 \n\t'<|>é_漢ſ  .,s#\x1c\x85²½ɐ\u3000"), max_size=40), max_size=4), st.sampled_from([1, 7, 1 << 20]))
def test_ids(texts, slice_size):
    global CODER
    CODER = globals().get("CODER") or packing.TextIds(*queries.tokenizer_files())
    texts = [*texts, "a <|endoftext|> b".join(texts)]
    before, packing.SLICE = packing.SLICE, slice_size
    try:
        got = [CODER.of(x).tolist() for x in texts]
    finally:
        packing.SLICE = before
    assert got == [CODER.coder.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_closed_windows(lengths):
    closed = packing.close_windows(packing.pack_lengths(lengths, 100), lengths, 100)
    assert len(closed) == -(-sum(lengths) // 100)
    assert all(0 < sum(n for _, _, n in w) <= 100 for w in closed)
    places = sorted((k, at, n) for w in closed for k, at, n in w)
    assert [k for k, at, _ in places if at == 0] == list(range(len(lengths)))
    assert all(sum(n for k, _, n in places if k == i) == lengths[i] for i in range(len(lengths)))


def test_packing_repeated_and_long_rows(spark):
    """Many equal rows, and rows that are many whole cuts; the same sequences however the rows lie."""
    rows = [(7, "same words again and again")] * 500 + [(None, "x")] * 30 + [(k, "word " * 2047 * (k % 4)) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = [packing.pack_documents(d, *queries.tokenizer_files(), full_group=16) for d in (df.coalesce(1), df.repartition(7))]
    first, again = (sorted(map(str, m.collect())) for m in made)
    assert first == again
    got = made[0].collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // 2048)
    whole = [r for r in got if r.length == 2048]
    assert len({r.sequence_id for r in whole}) == len(whole) > 30
    assert sum(r.doc_id == 7 and r.start == 0 for r in got) == 500


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}


def test_line_spread_is_exact_at_the_threshold(spark):
    rows = [(k, f"line {n}", f"site{k}") for n in (9, 10, 11, 40) for k in range(n)] + [(0, "line 9", "site0"), (1, "line 9", None)]
    got = {r.n_sites for r in line_dedup.line_spread(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert 9 not in got and {10, 11} <= got and len(got) == 3


def test_frames_go_and_copies_stay(spark):
    """A line of many sites goes from long texts and from pages that it mostly fills; a text that twelve sites copy whole stays, one that they copy
    nearly loses the lines that they share."""
    copy = [f"line {k} of a text that is copied" for k in range(6)]
    rows = [(k, f"Home | News | About us\n{k} own words " * 1 + "and more of them " * 10, f"s{k}") for k in range(12)]
    rows += [(20, "Home | News | About us\nshort", "s1"), (21, "Home | News | About us", None), (22, None, "s1"), (23, "", "s2")]
    rows += [(30 + k, "\n".join(copy), f"s{k}") for k in range(12)]
    rows += [(50 + k, "\n".join([*copy[: k % 6], f"changed in {k}", *copy[k % 6 + 1 :]]), f"s{k}") for k in range(12)]
    rows += [(70, "\n".join(copy), "s1")] * 5
    rows += [(100 + k, f"Navigation\nown {k}", f"t{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.drop_spread_lines(df).collect()
    docs = [dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in rows]
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((d["doc_id"], t or "") for d, t in zip(docs, brute.clean_lines(docs), strict=True))
    texts = {r.doc_id: r for r in got}
    assert all(texts[k].removed_lines == 1 and "Home" not in texts[k].text for k in [*range(12), 20, 21])
    assert all(r.removed_lines == 0 and r.text == rows[16][1] for r in got if 30 <= r.doc_id < 42 or r.doc_id == 70)
    assert all(texts[50 + k].text == f"changed in {k}" for k in range(12)) and texts[22].text is None
    assert all(texts[100 + k].text == f"own {k}" for k in range(40))
    every = {r.doc_id: r.text for r in line_dedup.drop_spread_lines(df, keep_copies=False).collect()}
    assert every[30] == every[70] == "" and every[100] == "own 0"


def test_warc_chain(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nv", f"start {fake}{fake} end"), (4, "u", fake), (5, "u", fake), (6, "u", "é" * 1000), (7, "u", fake), (8, "u", "x\r\n\r\n"), (9, "u", "WARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df.coalesce(2), f"file://{tmp_path}/a")
    got = {r.key: r for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert set(got) == set(range(1, 10)) and all(r.intact for r in got.values())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {1: 2, 4: 7, 5: 7}
    assert {k: r.payload_bytes for k, r in got.items()} == {k: len((h or "").encode()) for k, _, h in rows}
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").collect() == []


def test_neighbours_of_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.standard_normal(20)]) for k in range(200)]
    rows += [(300, None), (320, [0.0] * 20), (340, [float("nan")] * 20), (360, [None] * 20), (380, []), (None, [1.0] * 20), (400, [1.0, 2.0])]
    rows += [(500 + k, rows[0][1]) for k in range(1, 20)] + [(0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in onebit.nearest(df, data_block=64, query_block=4).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = x
    assert set(got) == set(range(0, 200, 20))
    x = {k: np.array(v) for k, v in rows if k is not None and v and len(v) == 20 and k not in (320, 340, 360)}
    hit = 0
    for q, own in got.items():
        assert list(range(1, 21)) == sorted(own) and q not in {y.vec_id for y in own.values()}
        best = sorted((i for i in x if i != q), key=lambda i: (-round(float(x[i] @ x[q]), 9), i))[:20]
        hit += len(set(best) & {y.vec_id for y in own.values()})
    assert hit >= 195
    assert [own.vec_id for _, own in sorted(got[0].items())][:19] == list(range(501, 520))
    assert onebit.nearest(df.limit(0)).collect() == []


def test_neighbours_of_repeated_keys(spark):
    """The order of rows changes nothing, and columns named as the operator's own do no harm."""
    rows = [(0, [1.0, 2.0], "a", 1), (0, [-3.0, 9.0], "b", 2), (1, [0.5, 3.0], "c", 3), (1, [0.5, 3.0], "c", 3), (2, [-1.0, 0.0], "d", 4)]
    made = [spark.createDataFrame(r, "vec_id long, embedding array<float>, code string, dim int") for r in (rows, rows[::-1])]
    first, again = (sorted(map(tuple, onebit.nearest(d).collect())) for d in made)
    assert first == again == [(0, 1, 1, 6.5), (0, 2, 2, -1.0)]


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    files = [(1, "LICENSE", licenses.TEMPLATES["MIT"][2]), (2, "a/COPYING", licenses.TEMPLATES["GPL-3.0"][1]), (3, "a/b/x.py", "import os"), (4, "c/y.py", "print"), (5, "a/z.py", "# " + licenses.TEMPLATES["Apache-2.0"][0] + "\ncode here"), (6, None, "x")]
    got = {r.doc_id: (r.license, r.from_directory) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("GPL-3.0", None), 3: ("GPL-3.0", "a"), 4: ("MIT", ""), 5: ("Apache-2.0", None), 6: (None, None)}


def scanned(spark, files):
    return {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}


def test_a_frequent_notice_is_found(spark):
    notice = licenses.TEMPLATES["MIT"][0]
    rows = [(k, f"s{k % 3}/{k}.txt", "\n".join([f"w{k} x{n} y{k * n}" for n in range(8)] + [notice] * (k % 3 == 0))) for k in range(300)]
    got = scanned(spark, rows)
    assert {k for k, r in got.items() if r.own_license == "MIT"} == set(range(0, 300, 3))
    assert all(r.cosine == 1.0 for k, r in got.items() if k % 3 == 0)


def test_three_lines_are_enough(spark):
    got = scanned(spark, [(1, "LICENSE", licenses.TEMPLATES["MIT"][0]), (2, "a/x.py", "import os"), (3, "a/y.py", "print")])
    assert {k: r.license for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT"}


def test_a_tree_of_inheriting_files(spark):
    """Three levels of directories, most files without a licence of their own: each inherits from the nearest directory above that holds one."""
    notice = {n: t[0] for n, t in licenses.NOTICES.items() if n != "Proprietary"}
    names = sorted(notice)
    files, want, k = [], {}, 0
    for a in range(12):
        top = names[a % len(names)] if a % 3 else None
        if top:
            files.append((k, f"a{a}/LICENSE", notice[top]))
            want[k], k = top, k + 1
        for b in range(6):
            own = names[(a + b) % len(names)] if b == 2 else None
            if own:
                files.append((k, f"a{a}/b{b}/COPYING.md", notice[own]))
                want[k], k = own, k + 1
            for c in range(4):
                files.append((k, f"a{a}/b{b}/c{c}/f{c}.py", f"import x{c}\nrun(y{k})"))
                want[k], k = own or top, k + 1
    got = scanned(spark, files)
    assert {i: r.license for i, r in got.items()} == want
    assert sum(r.from_directory is not None for r in got.values()) > 200


LICENSES = Path(licenses.__file__).parent / "license_texts"


def test_whole_licence_files_are_told_apart(spark):
    rows = [(k, f"d{k}/LICENSE", "Copyright (c) 2020 Some Body. All rights reserved.\n\n" + p.read_text()) for k, p in enumerate(sorted(LICENSES.glob("*.txt")))]
    got = scanned(spark, rows + [(100 + k, f"d{k}/x.py", "import os") for k, *_ in rows])
    want = [p.stem for p in sorted(LICENSES.glob("*.txt"))]
    assert len(want) == 16
    assert [got[k].own_license for k in range(len(want))] == [got[100 + k].license for k in range(len(want))] == want
    assert all(got[k].is_license_file for k in range(len(want)))


def test_all_rights_reserved_counts_last(spark):
    opening = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    got = scanned(spark, [(1, "a/LICENSE", opening), (2, "a/x.py", "import os"), (3, "b/LICENSE", "All rights reserved."), (4, "b/x.py", "import os")])
    assert {k: r.license for k, r in got.items()} == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "Proprietary", 4: "Proprietary"}


def test_a_near_copy_leaves_unlike_texts_of_its_key(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b + " tail"), (4, c), (4, c), (5, None), (None, a), (None, "no other text is like this one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_copy_stage(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (4, c), (5, None), (None, "no other text is like this one"), (None, None)], key=str)


STAGE_CLASH = [c for c in CLASH if c != "n_chars"] + ["text_hash", "later_id", "component_id", "drop", "lines", "print", "base_failed", "n_words", "a.b", "c0", "_domain", "covered_words", "h", "g", "copied"]


@pytest.fixture(scope="module")
def stage_docs(spark):
    rows = [(*r, len(r[1] or ""), *[f"own {c}" for c in STAGE_CLASH]) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in STAGE_CLASH))


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, stage_docs, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    empty = stage(spark, stage_docs.limit(0), "")
    assert empty.collect() == []
    got = stage(spark, stage_docs, "")
    if k < 4:
        assert got.columns == empty.columns == stage_docs.columns
    rows = got.collect()
    if k < 4:
        assert rows and all(r[c] == f"own {c}" for r in rows for c in STAGE_CLASH)
        known = {(r[0], r[1], r[2], r[3]) for r in ROWS}
        assert all((r.doc_id, r.text, r.lang, r.source) in known for r in rows)
    key = lambda r: -1 if r.doc_id is None else r.doc_id
    keys = sorted(map(key, rows))
    want = sorted(-1 if r[0] is None else r[0] for r in ROWS)
    if k == 0:  # texts of under ten words go; the long ones repeat nothing
        assert keys == sorted(-1 if r[0] is None else r[0] for r in ROWS if brute.quality(r[1])["kept"])
    elif k == 1:
        assert keys == want and {r.doc_id: r.text for r in rows}[1] is None
        assert all(r.n_chars == len(r.text or "") for r in rows)
    elif k == 2:  # 5 is a copy of 4 (and repeats itself), 7 a near copy of 6, 10 of 9
        assert keys == [-1, 1, 2, 3, 4, 6, 8, 9]
    elif k == 3:
        assert set(keys) <= set(want) and len(keys) == len(set(keys)) + sum(key == 5 for key in keys) // 2
        assert sum(len(brute.words(r.text)) for r in rows) <= 0.8 * sum(len(brute.words(r[1])) for r in ROWS)
    else:
        assert set(keys) == set(want)
        assert sum(r.start == 0 for r in rows) == len(ROWS)


def test_warc_scan_layout_changes_nothing(spark, tmp_path):
    """Records whose payload holds magic and complete records, in one file and several splits, read under a layout that changes between planning and running."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(k, f"http://x/{k}", f"page {k} " + (inner * (k % 5) + "WARC/1.1\r\n") * (k % 3 == 0) + "t" * (k * 37 % 500)) for k in range(40)]
    rows += [(None, "n", "no key"), (None, "n", "no key"), (50, "u", "same"), (50, "u", "same"), (60, "long", "é " * 200_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, key string, body string")
    warc.write_archives(df.coalesce(1), f"file://{tmp_path}/a")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    seen = []
    try:
        for size, parallel in (("4k", "1"), ("1m", "3"), ("128m", "40")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
            planned = warc.read_archives(spark, f"file://{tmp_path}/a")
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallel)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
            seen.append(sorted(map(str, planned.collect())))
            assert len(seen[-1]) == len(rows) and all("intact=True" in x for x in seen[-1])
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        for c, v in before.items():
            spark.conf.set(c, v)
    assert seen[0] == seen[1] == seen[2]
    got = {r.key: r for r in planned.collect() if r.key is not None and r.key != 50}
    assert {k: r.payload_bytes for k, r in got.items()} == {k: len(h.encode()) for k, _, h in rows if k not in (None, 50)}
    assert [r.record_type for r in planned.collect() if r.key == 50] == ["response", "response"]


def test_a_broken_record_ends_its_file(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"p{k}") for k in range(6)], "page_id long, url string, html string")
    warc.write_archives(df.coalesce(1), f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("part-*")
    whole = file.read_bytes()
    for told in (b"-70", b"9999999", b"x"):
        cut = whole.split(b"Content-Length: ")
        cut[5] = told + cut[5][cut[5].index(b"\r") :]  # the third record's own length
        (tmp_path / told.decode()).mkdir()
        (tmp_path / told.decode() / "part-0").write_bytes(b"Content-Length: ".join(cut))
        got = warc.read_archives(spark, f"file://{tmp_path}/{told.decode()}").collect()
        assert {0, 1} <= {r.key for r in got if r.intact} and not {3, 4, 5} & {r.key for r in got}


def small_bags():
    r = np.random.default_rng(8)
    runs = np.array([1, 3, 2, 5])
    return r.standard_normal((runs.sum(), 7)), runs, np.array([0.0, 1, 1, 0])


def test_attention_against_a_plain_version():
    x, runs, y = small_bags()
    model = attention.GatedAttention(7, hidden=5, gate=3)
    model.fit(x, runs, y, rounds=3)
    f = model.forward(x, runs)
    scores, weights = brute.attended(model, x, runs)
    assert np.allclose(f["y"], scores) and np.allclose(f["a"], weights)
    assert np.allclose(np.add.reduceat(f["a"], np.cumsum(runs) - runs), 1)


def test_attention_gradients_against_differences():
    x, runs, y = small_bags()
    model = attention.GatedAttention(7, hidden=5, gate=3)
    w = np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        p = model.forward(x, runs)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    for name, g in model.gradients(model.forward(x, runs), runs, y, w).items():
        p = model.p[name]
        for k in range(p.size):
            before, eps = p.flat[k], 1e-6
            p.flat[k] = before + eps
            up = loss()
            p.flat[k] = before - eps
            down = loss()
            p.flat[k] = before
            assert abs((up - down) / (2 * eps) - g.flat[k]) < 1e-6, (name, k)


def test_attention_learns_which_passage_counts():
    """One passage of each positive document carries the sign; its weight ends up above an even share."""
    r = np.random.default_rng(4)
    runs = np.full(200, 6)
    x = r.standard_normal((1200, 4)) * 0.3
    y = np.arange(200) % 2.0
    x[np.arange(200) * 6 + 2, 0] += 4 * y
    model = attention.GatedAttention(4)
    model.fit(x, runs, y)
    f = model.forward(x, runs)
    assert ((f["y"] > 0.5) == (y > 0.5)).mean() > 0.97
    assert f["a"].reshape(200, 6)[y > 0.5, 2].mean() > 2 / 6


def test_repeats_of_a_labelled_key_are_one(spark, monkeypatch):
    good, bad = "calm words of a sound text about rivers and hills", "xx || xx || xx || 12 12 12 ### ###"
    rows = [(k, good if k % 2 else bad) for k in range(60)] + [(3, "another text of key three " * (1 + k % 3)) for k in range(500)]
    fitted = []
    fit = attention.GatedAttention.fit
    monkeypatch.setattr(attention.GatedAttention, "fit", lambda self, x, runs, y: (fitted.append((len(x), len(runs))), fit(self, x, runs, y)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    scored = attention.score_quality(df, labels).collect()
    assert len(scored) == 560 and fitted[0][1] <= 60
    attention.score_quality(df, labels, train_passages=20).collect()
    assert fitted[1][0] <= 20


def test_jaccard_of_repeated_rows_and_null_keys(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(80)) for p in "abc")
    rows = [(5, a)] * 40 + [(3, a + " tail"), (None, a + " other"), (None, b), (None, b), (None, b + " tail"), (9, c), (8, None), (None, ""), (7, c), (7, c + " tail")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(5, 76, 3)] * 40 + [(3, 77, 3), (None, 77, 3), (None, 76, None), (None, 76, None), (None, 77, None), (9, 76, 7), (8, 0, 8), (None, 0, None), (7, 76, 7), (7, 77, 7)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def plain_place(loads, shards, first=0):
    """Vector bin packing, unit by unit and shard by shard."""
    dims = range(loads.shape[1])
    spare = {s: [sum(row[d] for row in loads) / shards for d in dims] for s in range(shards)}
    out = {}
    for k in sorted(range(len(loads)), key=lambda k: (-loads[k][0], k)):
        turn = [(s + first) % shards for s in range(shards)]
        best = max(turn, key=lambda s: (sum(loads[k][d] * spare[s][d] for d in dims), -turn.index(s)))
        out[k] = best
        spare[best] = [spare[best][d] - loads[k][d] for d in dims]
    return [out[k] for k in range(len(loads))]


@pytest.mark.parametrize("seed", range(4))
def test_placing_against_a_plain_version(seed):
    loads = np.random.default_rng(seed).integers(1, 2**20, (150, 3)) / 2.0**10  # exact sums
    assert sharding.place(loads, 8, 3 * seed).tolist() == plain_place(loads, 8, 3 * seed)


def test_slots_in_runs_and_parts(spark):
    """A group of half the rows is split, a shard's rows are numbered in many runs and blocks: gapless all the same, and within the packing's bound."""
    rows = [(k, "the same text" if k % 2 else f"text {k} " + "w " * (k % 40)) for k in range(4000)] + [(7, "the same text")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=5, parts=4, block_units=200, slot_run=30).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    slots, loads = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert set(slots) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 5
    assert len({r.shard for r in got if r.size == 13 + 16}) == 5
    whole = sharding.shard_documents(docs, shards=5, parts=4, block_units=10**6)
    assert max(r.n for r in whole.groupBy("shard").agg(F.sum("size").alias("n")).collect()) < 1.1 * sum(loads.values()) / 5


def test_op7_against_a_plain_version(spark):
    """Every distinct text of the table, so that no group is split: the shards are those of the plain version on the same units."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    units = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text").orderBy("h").collect()
    loads = np.array([(len((r.text or "").encode()) + 16, len(brute.words(r.text)), 1) for r in units], float)
    want = plain_place(loads / loads.sum(axis=0) * np.sqrt((1.0, 0.05, 0.05)), 40)
    got = {r.doc_id: (r.shard, r.size) for r in sharding.shard_documents(docs).collect()}
    assert got == {r.doc_id: (shard, int(load[0])) for r, shard, load in zip(units, want, loads, strict=True)}


def test_told_lengths_that_no_file_has(spark, tmp_path):
    """Pages that hold record heads with any length at all come back as they are."""
    lengths = ["2147483647", "2147483648", "99999999999", "9007199254740992", "9007199254740993", "9223372036854775807", "9223372036854775808", "-1", "-9223372036854775808", "1" * 30, "0", "+5", " 7 ", "x", ""]
    rows = [(k, "u", f"before WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\nabc\r\n\r\nafter {k}") for k, n in enumerate(lengths)]
    rows += [(100 + k, "u", f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n") for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df.coalesce(1), f"file://{tmp_path}/a")
    got = {r.key: r for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert {k: r.payload_bytes for k, r in got.items()} == {k: len(h) for k, _, h in rows}
    assert all(r.intact for r in got.values())
    # The same lengths told by records themselves: what they say is not believed, and what follows them is not reached.
    (file,) = (tmp_path / "a").glob("part-*")
    whole = file.read_bytes()
    for k, n in enumerate(lengths):
        head, tail = whole.split(b"WARC/1.1\r\n", 2)[1:]
        first = b"WARC/1.1\r\n" + head
        at = first.index(b"Content-Length: ")
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "part-0").write_bytes(first[:at] + b"Content-Length: " + n.encode() + first[first.index(b"\r", at) :] + b"WARC/1.1\r\n" + tail)
        warc.read_archives(spark, f"file://{tmp_path}/b{k}").collect()


def test_kindred_licences_are_told_apart(spark):
    """Every notice and every whole licence finds itself, in a corpus of its own; so do texts with a head, and with some words changed."""
    rows, want = [], {}
    for name, texts in licenses.TEMPLATES.items():
        for x in texts:
            for shape in (x, f"Copyright (c) 2021 The Authors\n\n{x}", x.replace(" the ", " this ", 2)):
                want[len(rows)] = name
                rows.append((len(rows), f"d{len(rows)}/LICENSE", shape))
    got = scanned(spark, rows)
    wrong = {(k, want[k], r.own_license) for k, r in got.items() if r.own_license != want[k]}
    assert not wrong
    more = [(0, "a/LICENSE", "This library is under the GNU Lesser General Public License, version 2.1"), (1, "b/LICENSE", "licensed under the GNU AFFERO GENERAL PUBLIC LICENSE, version 3")]
    assert {k: r.own_license for k, r in scanned(spark, more).items()} == {0: "LGPL-2.1", 1: "AGPL-3.0"}


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_sets_of_one_signature_stay_apart(spark, monkeypatch, bits):
    """Signatures of few bits, which many unlike sets share: the nodes that do get names of their own, and nothing else changes."""
    rows = [(k, " ".join(f"w{(k // 4) * 50 + j}" for j in range(40)) + (f" tail{k}" if k % 2 else "")) for k in range(80)] + [(200, "w0 w1"), (201, "w0 w2"), (202, None)]
    plain = jaccard._signature
    monkeypatch.setattr(jaccard, "_signature", lambda s: plain(s) % (1 << bits))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.components(rows))
