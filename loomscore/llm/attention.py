"""Quality classifier: gated-attention multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .mixing import word_count
from .wordhash import pieces, word_hashes

PASSAGE = 64
_CLASS = np.zeros((256, 5), np.float32)
for _k, _chars in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,;:!?", bytes(range(128, 256)))):
    _CLASS[list(_chars), _k] = 1
FEATURES = 5 + 6 + 64


def passages(texts: list[bytes], width: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of each run of `width` words of each text, in order, and each text's number of runs (a text without words has one)."""
    texts = [t if t.strip() else b"\x00" for t in texts]
    words, counts = word_hashes(texts, lower=False)
    low, _ = word_hashes(texts, lower=True)
    starts_of_text = np.cumsum(counts) - counts
    runs = -(-counts // width)
    total = int(runs.sum())
    within = np.arange(len(words)) - np.repeat(starts_of_text, counts)
    passage = np.repeat(np.cumsum(runs) - runs, counts) + within // width
    size = np.bincount(passage, minlength=total).astype(np.float32)
    first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    # Bytes: the share of each class among those of the passage's words.
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[first]
    volume = np.add.reduceat((~blank).astype(np.float32), begin)
    kinds = np.stack([np.add.reduceat(_CLASS[:, k][raw], begin) for k in range(_CLASS.shape[1])], axis=1) / volume[:, None]
    lines = np.add.reduceat((raw == 10).astype(np.float32), begin) / size
    # Words: how many repeat another of the passage, or one shortly before.
    order = np.lexsort((low, passage))
    again = (low[order][1:] == low[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    same = np.bincount(passage[order][1:][again], minlength=total) / size
    echo = []
    for lag in (1, 2, 3):
        hit = (words[lag:] == words[:-lag]) & (passage[lag:] == passage[:-lag])
        echo.append(np.bincount(passage[lag:][hit], minlength=total) / size)
    scalar = np.stack([np.log1p(size) / 4, volume / size / 8, lines, same, echo[0], echo[1] + echo[2]], axis=1)
    # Word identities, in hashed signed counts.
    spot = (low >> np.uint64(58)).astype(np.int64)
    sign = np.where((low >> np.uint64(57)) & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(passage * 64 + spot, sign, total * 64).reshape(total, 64) / size[:, None]
    return np.concatenate([kinds, scalar, hashed], axis=1).astype(np.float32), runs


class GatedAttention:
    """Passages x -> h = tanh(x W + b); attention a = softmax(u . (tanh(h V) * sigmoid(h G))); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, inputs: int, hidden: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": make(inputs, hidden), "b": np.zeros(hidden), "V": make(hidden, gate), "G": make(hidden, gate), "u": make(gate), "c": make(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)

    def forward(self, x: np.ndarray, runs: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (t * s) @ p["u"]
        at = np.cumsum(runs) - runs
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), runs))
        a = e / np.repeat(np.add.reduceat(e, at), runs)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, f: dict[str, np.ndarray], runs: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        dy = (f["y"] - y) * w / w.sum()
        dz = np.repeat(np.outer(dy, p["c"]), runs, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        at = np.cumsum(runs) - runs
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), runs))
        du = np.outer(de, p["u"])
        dt, ds = du * f["s"] * (1 - f["t"] ** 2), du * f["t"] * f["s"] * (1 - f["s"])
        dh = dz * f["a"][:, None] + dt @ p["V"].T + ds @ p["G"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "G": f["h"].T @ ds, "u": ((f["t"] * f["s"]) * de[:, None]).sum(axis=0), "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, runs: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Adam over shuffled batches of documents; both classes weigh alike."""
        self.mean, self.scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3
        weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
        at = np.cumsum(runs) - runs
        r = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for turn in range(rounds):
            order = r.permutation(len(y))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                rows = np.concatenate([np.arange(at[i], at[i] + runs[i]) for i in own])
                f = self.forward(x[rows], runs[own])
                step += 1
                for name, g in self.gradients(f, runs[own], y[own], weight[own]).items():
                    g = g + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    pace = rate * (1 - turn / rounds)
                    self.p[name] = self.p[name] - pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    train_documents: int = 4000,
    train_passages: int = 120_000,
) -> DataFrame:
    """(key, held_out, score, predicted) of every document, scored over all passages of its whole text.

    Rows whose crc32(key as text) mod 3 is 1 are held out: their labels are never read. The model learns from a bounded sample of
    the others, of each label the documents first by hash of the key: at most train_documents / 2 of them, and no more than have
    train_passages / 2 passages in all (a document with more than that alone is passed over). Each is taken with all its passages, and a
    key that several rows have with the least of their texts. So at most train_passages rows of FEATURES floats come to the
    driver; the model goes out as a few thousand numbers.

    Only the text is an input. Null and empty texts have one passage without words and a score like any other. Keys with null or
    conflicting labels teach nothing; without both labels every score is 0.5. Repeated rows score alike, a null key
    passes through (not held out), other columns are not read, an empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~held).groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("key", "y")
    known = known.withColumn("h", F.xxhash64("key", F.lit(29)))
    half = train_documents // 2
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy("h").limit(half)
        sample = part if sample is None else sample.union(part)
    # At most train_documents rows are sent; rows that repeat a key are one before anything is collected.
    drawn = settle(docs.join(F.broadcast(sample), "key").groupBy("key", "y", "h").agg(F.min("text").alias("text")))
    runs = F.greatest(F.lit(1), F.ceil(word_count("text") / PASSAGE))
    sized = drawn.select("key", "y", "h", runs.alias("runs")).filter(F.col("runs") <= train_passages // 2)
    upto = F.sum("runs").over(Window.partitionBy("y").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sized.withColumn("upto", upto).filter(F.col("upto") <= train_passages // 2)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in pieces(batches, "text", 1 << 21):
            x, runs = passages(raw)
            kept = [part.tobytes() for part in np.split(x, np.cumsum(runs)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kept, pa.binary())], names=["key", "y", "x"])

    learned = drawn.join(fitting.select("key"), "key").select("key", "text", "y").mapInArrow(features, f"key {kind}, y int, x binary")
    rows = sorted(learned.toLocalIterator(), key=lambda r: r.key)
    y = np.array([r.y for r in rows], np.float64)
    model = None
    if len(set(y.tolist())) == 2:
        xs = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
        counts = np.array([len(x) for x in xs])
        del rows
        model = GatedAttention(FEATURES)
        model.fit(np.concatenate(xs), counts, y)
    sent = spark.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in pieces(batches, "text", 1 << 21):
            if sent.value is None:
                score = np.full(len(raw), 0.5)
            else:
                x, runs = passages(raw)
                score = sent.value.forward(x.astype(np.float64), runs)["y"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["key", "held_out", "score", "predicted"],
            )

    asked = docs.select("key", held.alias("held_out"), "text")
    return asked.mapInArrow(judge, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)
