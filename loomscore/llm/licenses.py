"""License scans: TF-IDF cosine of lines, paragraphs and files to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, salts_for, settle
from .wordhash import pieces

#: Licence identifiers, with notices as they stand in headers and the openings of the licence files.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "Artistic-2.0": ("Licensed under the Artistic License 2.0.",),
    "Zlib": ("Licensed under the zlib License.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "ISC": ("Licensed under the ISC License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
}
#: Whole licences (that of CC-BY-NC-4.0 is CC-BY-4.0's with the clauses that differ, BSD-2-Clause is BSD-3-Clause without its third, AGPL-3.0 is
#: GPL-3.0 under its own name with its paragraph on use over a network).
FULL: dict[str, str] = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in resources.files(__package__).joinpath("license_texts").iterdir()}
NETWORK = (
    "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely "
    "through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the "
    "Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.\n\n"
)
_HEAD, _, _TAIL = FULL["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General").partition("  14. ")
FULL["AGPL-3.0"] = f"{_HEAD}{NETWORK}  14. {_TAIL}"
#: Templates whose cosines lie within this of the best one's are told apart by the terms in which they differ.
MARGIN = 0.02
TEMPLATES: dict[str, tuple[str, ...]] = {name: (*texts, *filter(None, [FULL.get(name)])) for name, texts in NOTICES.items()}
#: Stands in files of many licences, so it counts where nothing else reaches the threshold.
GENERIC = "Proprietary"
_TERM = re.compile(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    """Lower-cased words and version numbers."""
    return _TERM.findall(text.lower())


def units(text: str) -> list[str]:
    """What is compared: each line with a term, each paragraph of two lines or more, and the whole text."""
    lines = [x for x in text.split("\n") if x.strip()]
    out = dict.fromkeys(lines)
    out.update(dict.fromkeys(x for x in re.split(r"\n[ \t\r]*\n", text) if "\n" in x.strip()))
    if len(lines) > 1:
        out[text] = None
    return list(out)


class Model:
    """TF-IDF weights from counts over all lines of the corpus; terms of no template weigh as if they had never been seen.

    Every unit is compared with every template: a unit that shares no term with any has cosine 0."""

    def __init__(self, lines: int, counts: dict[str, int], at_least: float = 0.7):
        weight = lambda n: math.log((1 + lines) / (1 + n)) + 1
        self.known = {t: weight(n) for t, n in counts.items()}
        self.other, self.at_least = weight(0), at_least
        kept = [(name, x) for name, texts in TEMPLATES.items() for x in texts]
        vectors = [self.vector(terms(x)) for _, x in kept]
        self.names = [name for name, _ in kept]
        self.row = {t: k for k, t in enumerate(sorted({t for x in vectors for t in x}))}
        self.matrix = np.array([[x.get(t, 0.0) for x in vectors] for t in self.row])
        counts = [Counter(terms(x)) for _, x in kept]
        self.counts = np.array([[c[t] for c in counts] for t in self.row])
        # Of the templates that reach at_least, a whole licence goes before a notice, and a notice before the generic one.
        self.tier = np.array([3 if x == FULL.get(name) else 1 if name == GENERIC else 2 for name, x in kept])

    def raw(self, found: list[str]) -> dict[str, float]:
        known, other = self.known, self.other
        return {t: known.get(t, other) * (1 if n == 1 else 1 + math.log(n)) for t, n in Counter(found).items()}

    def vector(self, found: list[str]) -> dict[str, float]:
        raw = self.raw(found)
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / norm for t, x in raw.items()}

    def best(self, text: str) -> tuple[str | None, float, int]:
        """The template nearest to any unit (first in the templates' order at equal cosine), the cosine, the unit's terms.

        Whole licences that reach at_least come before notices that do, these before the generic notice. Among templates of other licences
        within MARGIN of the best, kindred texts, the terms of which they have not equally many decide."""
        top, rank = (None, 0.0, 0), (0, 0.0)
        for unit in units(text):
            found = terms(unit)
            if self.row.keys().isdisjoint(found):
                continue
            raw = self.raw(found)
            shared = [t for t in raw if t in self.row]
            own = np.array([raw[t] for t in shared])
            norm = math.sqrt(sum(x * x for x in raw.values()))
            if (own @ own) ** 0.5 / norm < min(rank[1], 1.0 if rank[0] else self.at_least) - 1e-6:
                continue  # no template's cosine can be larger
            rows = [self.row[t] for t in shared]
            cosines = (own @ self.matrix[rows] / norm).round(9)
            at = int(cosines.argmax())
            tier = 0
            if cosines[at] >= self.at_least:
                reached = np.where(cosines >= self.at_least, self.tier, 0)
                tier = int(reached.max())
                at = int(np.where(reached == tier, cosines, -1).argmax())
                near = np.flatnonzero((reached == tier) & (cosines >= cosines[at] - MARGIN))
                if len({self.names[k] for k in near}) > 1:
                    at = self.kindred(near, at, own, rows)
            if (tier, cosines[at]) > rank:
                rank = (tier, cosines[at])
                top = (self.names[at], float(cosines[at]), len(found))
        return top

    def kindred(self, near: np.ndarray, at: int, own: np.ndarray, rows: list[int]) -> int:
        """Of near templates the one nearest by the terms of which they have not equally many; `at` if the unit has none of them."""
        differ = np.ptp(self.counts[:, near], axis=1) > 0
        kept = differ[rows]
        if not kept.any():
            return at
        part = self.matrix[np.array(rows)[kept]][:, near]
        size = np.sqrt((self.matrix[differ][:, near] ** 2).sum(axis=0))
        likeness = (own[kept] @ part / np.where(size > 0, size, 1)).round(9)
        return int(near[likeness.argmax()]) if likeness.max() > likeness[near.tolist().index(at)] else at


def scan_licenses(
    files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", at_least: float = 0.7, whole_share: float = 0.5
) -> DataFrame:
    """(key, path, own_license, cosine, is_license_file, license, from_directory) of every file.

    own_license: of the template nearest to any line, paragraph or the whole text, if the cosine is at_least that; whole licences
    that reach it come before notices, notices before the generic 'All rights reserved.'. A file is a
    licence file if its name is LICENSE, LICENCE, COPYING or NOTICE (any ending), or if the licence's unit has at least whole_share of its
    terms. A file without a licence of its own gets that of the nearest directory at or above its own that holds a licence file
    (licences of files so named first, then the highest cosine and the least licence and path decide within a directory);
    from_directory names it.

    Every unit of every text is compared, whatever the counts are. Term counts cover every
    line of every text: partial counts for each task, of the templates' few thousand terms. Inheritance
    joins distinct directories with their ancestors (those below one ancestor dealt over several tasks), then files with directories. Null and empty texts have no licence of
    their own; files with a null path neither give nor inherit; repeated rows are judged alike; other columns are not read; an
    empty table gives an empty result."""
    spark = files.sparkSession
    files = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    kind = files.schema["key"].dataType.simpleString()
    vocabulary = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total, lines = frozenset(vocabulary), Counter(), 0
        for _, raw in pieces(batches, "text"):
            for x in raw:
                for line in x.decode("utf-8").lower().split("\n"):
                    found = wanted.intersection(_TERM.findall(line))
                    lines += bool(line.strip())
                    total.update(found)
        names = ["", *total]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([lines, *total.values()], pa.int64())], names=["term", "n"])

    counted = files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counted.collect()}  # the vocabulary's size at most
    lines = counts.pop("", 0)
    sent = spark.sparkContext.broadcast(Model(lines, {t: counts.get(t, 0) for t in vocabulary}, at_least))
    named = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$"

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, raw in pieces(batches, "text"):
            names, cosines, own = [], [], []
            for x in raw:
                decoded = x.decode("utf-8")
                name, cosine, size = model.best(decoded)
                names.append(name if cosine >= at_least else None)
                cosines.append(cosine)
                own.append(cosine >= at_least and size >= whole_share * len(terms(decoded)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(cosines), pa.array(own)],
                names=["key", "path", "own_license", "cosine", "mostly"],
            )

    shape = f"key {kind}, path string, own_license string, cosine double, mostly boolean"
    judged = files.mapInArrow(judge, shape)
    by_name = F.coalesce(F.col("path").rlike(named), F.lit(False))
    is_file = F.col("own_license").isNotNull() & (F.col("mostly") | by_name)
    # The directory of a path, without its last part; "" is the root.
    judged = judged.withColumns({"is_license_file": is_file, "by_name": by_name, "dir": F.regexp_replace("path", "/?[^/]*$", "")}).drop("mostly")
    judged = settle(judged)
    first = Window.partitionBy("dir").orderBy(F.desc("by_name"), F.desc("cosine"), "own_license", "path")
    given = judged.filter("is_license_file AND dir IS NOT NULL").groupBy("dir", "own_license")
    given = given.agg(F.max("by_name").alias("by_name"), F.max("cosine").alias("cosine"), F.min("path").alias("path"))
    given = settle(given.withColumn("k", F.row_number().over(first)).filter("k = 1").selectExpr("dir AS ancestor", "own_license AS given"))
    dirs = settle(judged.filter("dir IS NOT NULL AND own_license IS NULL").groupBy("dir").agg(F.count("*").alias("n")))
    sizes = dirs.agg(F.count("*").alias("dirs"), F.max("n").alias("most"), F.sum("n").alias("files")).first()
    parts = F.split("dir", "/")
    depths = F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))))
    above = dirs.withColumn("depth", depths).withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = join_hot(above, given, ["ancestor"], salts=salts_for(sizes["dirs"]), by="dir", few_rows=given.count()).groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("near"))
    nearest = settle(nearest.selectExpr("dir", "near.ancestor AS ancestor", "near.given AS given"))
    # Files that lack a licence meet their directory's; those of one with over a thousandth of all files, which a thousand are at most, are dealt over
    # several tasks. There may be nearly as many directories as files, so these are never sent to every task. The others meet nothing.
    hot = dirs.filter(F.col("n") > (sizes["files"] or 0) / 1000)
    lacks = F.col("own_license").isNull() & F.col("dir").isNotNull()
    met = join_hot(judged.filter(lacks), nearest, ["dir"], "left", salts=salts_for(sizes["most"] or 0), hot=hot)
    joined = met.unionByName(judged.filter(~lacks), allowMissingColumns=True)
    return joined.select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        "own_license",
        "cosine",
        "is_license_file",
        F.coalesce("own_license", "given").alias("license"),
        F.col("ancestor").alias("from_directory"),
    )
