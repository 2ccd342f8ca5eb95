"""The queries against SQL, brute force, an exact round trip or held-out accuracy, on whole small tables."""

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscore.llm import jaccard, licenses, queries
from tests import oracle
from tests.llm import brute

DATA = oracle.DATA


def docs_of(spark, d=DATA):
    return [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    oracle.check(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name], oracle.connect())


def test_op2(spark):
    got = {r.doc_id: r.asDict() for r in queries.op2_quality_rules(spark, DATA).collect()}
    docs = docs_of(spark)
    assert set(got) == {d["doc_id"] for d in docs}
    for d in docs:
        want = brute.quality(d["text"])
        assert {k: got[d["doc_id"]][k] for k in want} == want, d["doc_id"]
    assert not all(r["kept"] for r in got.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_op4(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    rows = sorted((r.vec_id, r.embedding) for r in rows if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = defaultdict(list)
    for r in sorted(queries.op4_onebit_neighbours(spark, d).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hit = 0
    for q, own in got.items():
        at = int(np.searchsorted(ids, q))
        exact = (x * x[at]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -exact.round(12))) if k != at][:20]
        score = dict(zip(ids.tolist(), exact.tolist(), strict=True))
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len(set(ids[order].tolist()) & {r.vec_id for r in own})
    assert hit >= 0.99 * 20 * len(got)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_op5(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op5_quality_classifier(spark, d)
    held = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"])
    assert held["score"].between(0, 1).all()
    assert ((held["score"] >= 0.5) == (held["predicted"] == 1)).all()
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.85
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    # Copies and near copies of documents that may have taught count for nothing.
    labelled = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id")
    family = jaccard.jaccard_components(labelled).select("doc_id", "component_id").toPandas()
    taught = set(family[~family["doc_id"].isin(held["doc_id"])]["component_id"])
    alone = held[held["doc_id"].isin(family[~family["component_id"].isin(taught)]["doc_id"])]
    assert len(alone) > 500
    assert auc(alone["score"].to_numpy(), alone["quality"].to_numpy()) > 0.85


def test_op6(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d["doc_id"]: coder.encode(d["text"] or "", add_special_tokens=False).ids + [1] for d in docs_of(spark)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, DATA).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[key][r.start : r.start + r.length]
            assert (r.start, len(part), r.doc_tokens) == (at, r.length, len(ids[key]))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids[key])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(map(len, ids.values())) > 2048 * (len(sequences) - 2)


def test_op7(spark):
    docs = {d["doc_id"]: d["text"] or "" for d in docs_of(spark)}
    rows = queries.op7_sharding(spark, DATA).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 40
    assert max(loads.values()) <= mean + max(r.size for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op9(spark, sf):
    d = f"/root/testdata/{sf}"
    got = sorted(tuple(r) for r in queries.op9_ngram_jaccard(spark, d).select("doc_id", "n_shingles", "component_id").collect())
    want = brute.components([(x["doc_id"], x["text"]) for x in docs_of(spark, d)])
    assert got == want
    assert any(a != c for a, _, c in want)


def test_op10(spark):
    """A plain TF-IDF, each file's verdict and the inheritance, one file after another."""
    docs = docs_of(spark)
    paths = {r.doc_id: r.path for r in spark.read.parquet(f"{DATA}/documents.parquet").withColumn("path", queries.license_path()).collect()}
    model = brute.Licenses([d["text"] for d in docs], licenses.TEMPLATES)
    files = []
    for d in docs:
        path = paths[d["doc_id"]]
        name, cosine, size = model.best(d["text"] or "", licenses.FULL, licenses.GENERIC)
        own, by_name = name if cosine >= 0.7 else None, path.rpartition("/")[2].startswith("LICENSE.")
        mostly = size >= 0.5 * len(model.TERM.findall((d["text"] or "").lower()))
        files.append((d["doc_id"], path, own, cosine, own is not None and (mostly or by_name), by_name))
    given = {}
    for _, path, own, _, whole, _ in sorted(files, key=lambda f: (not f[5], -f[3], f[2] or "", f[1])):
        if whole:
            given.setdefault(path.rpartition("/")[0], own)
    want = {}
    for key, path, own, _, whole, _ in files:
        above = path.rpartition("/")[0]
        while own is None and above not in given and above:
            above = above.rpartition("/")[0]
        want[key] = (path, own, whole, own or given.get(above), above if own is None and above in given else None)
    got = {r.doc_id: (r.path, r.own_license, r.is_license_file, r.license, r.from_directory) for r in queries.op10_license_scan(spark, DATA).collect()}
    assert got == want
    assert sum(f is not None for *_, f in want.values()) > 20


def test_hundreds_of_files_inherit(spark):
    found = queries.op10_license_scan(spark, "/root/testdata/sf0.01")
    assert found.filter("from_directory IS NOT NULL").count() > 200


def test_pipeline(spark):
    import corpus_pipeline

    docs = docs_of(spark)
    weights, levels = queries.WEIGHTS, queries.LEVELS
    stage = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = stage.columns

    def run(k):
        nonlocal stage
        stage = corpus_pipeline.settle(corpus_pipeline.STAGES[k][1](spark, stage, DATA))
        return {r.doc_id: r.asDict() for r in stage.collect()}

    docs = [d for d in docs if brute.quality(d["text"])["kept"]]
    assert {k: d["text"] for k, d in run(0).items()} == {d["doc_id"]: d["text"] for d in docs}
    for d, text in zip(docs, brute.clean_lines(docs), strict=True):
        d["text"] = text
    assert {k: d["text"] for k, d in run(1).items()} == {d["doc_id"]: d["text"] for d in docs}
    first = {k: c for k, _, c in brute.components([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d for d in docs if first[d["doc_id"]] == d["doc_id"]]
    assert set(run(2)) == {d["doc_id"] for d in docs}
    for d in docs:
        number = "".join(c if c.isdigit() else " " for c in d["source"] or "").split(" ")[-1]
        d["domain"] = str(int(number or 0) % 4)
    docs_left = {k for k, _ in brute.mixed(docs, levels, weights)}
    assert set(run(3)) == docs_left
    assert stage.columns == columns
    packed = corpus_pipeline.STAGES[4][1](spark, stage, DATA)
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in totals} == docs_left
    assert all(r.n == r.m for r in totals)
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.groupBy("doc_id").count().count() == len(docs_left)
