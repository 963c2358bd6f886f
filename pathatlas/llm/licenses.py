"""License scans: sparse TF-IDF cosine of passages to templates, then inheritance from the nearest licensed directory.

Words are hashed to 2^18 features whose document frequencies come from all files (a fixed-size sum per task). Every line and
every sentence of a whole file, and the file as a whole, is a sparse TF-IDF row; its best cosine to a template decides. A
licence file (by name) gives its directory a licence; each distinct directory looks its ancestors up by equi-joins on path and
the deepest one counts, so files themselves are never multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECES, added, pieces, query, saved, table, word_hashes, words_at

BITS = 18
FEATURES = 1 << BITS
COSINE = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.\-][^/]*)?$"

RESERVED = "All rights reserved."  # many licences hold this line too, so it only counts where no other notice is found

# Short notices of well-known licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("Proprietary", RESERVED),
]


def _passages(text: str | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features of all words, and for each way of cutting (lines, sentences, whole) the passage number of each word."""
    words, at, raw = words_at(text)
    after = np.append(raw[1:], 32)
    line = np.flatnonzero(raw == 10)
    stop = np.flatnonzero(np.isin(raw, (33, 46, 59, 63)) & (after <= 32))
    feats = (words & np.uint32(FEATURES - 1)).astype(np.int64)
    return feats, [np.searchsorted(line, at), np.searchsorted(stop, at), np.zeros(len(words), np.int64)]


@dataclass
class Matcher:
    """Template vectors over their own words; all other words only count in a passage's length."""
    idf: np.ndarray
    names: list[str]
    column: np.ndarray  # feature -> row of ``weights``, -1 if in no template
    weights: np.ndarray  # (words of templates, templates), unit columns
    reserved: np.ndarray  # whether a template is RESERVED

    @classmethod
    def of(cls, idf: np.ndarray, templates: list[tuple[str, str]]) -> Matcher:
        rows = [np.unique((word_hashes(t) & np.uint32(FEATURES - 1)).astype(np.int64), return_counts=True) for _, t in templates]
        known = np.unique(np.concatenate([r[0] for r in rows] + [np.zeros(0, np.int64)])).astype(np.int64)
        column = np.full(FEATURES, -1, np.int32)
        column[known] = np.arange(len(known))
        weights = np.zeros((len(known), len(templates)))
        for j, (f, n) in enumerate(rows):
            weights[column[f], j] = (1 + np.log(n)) * idf[f]
        weights /= np.maximum(1e-12, np.linalg.norm(weights, axis=0))
        return cls(idf, [n for n, _ in templates], column, weights, np.array([t == RESERVED for _, t in templates], bool))

    def best(self, text: str | None) -> tuple[str | None, float]:
        """Licence and cosine of the passage that is most like a template; the first template wins a tie. RESERVED gives way to any other one that is found."""
        feats, cuts = _passages(text)
        if not len(feats) or not self.weights.size or not (self.column[feats] >= 0).any():
            return None, 0.0
        top = np.zeros(len(self.names))
        for passage in cuts:
            key, n = np.unique(passage * FEATURES + feats, return_counts=True)
            p, f = key // FEATURES, key % FEATURES
            w = (1 + np.log(n)) * self.idf[f]
            length = np.sqrt(np.bincount(p, w * w))
            own = self.column[f]
            hit = own >= 0
            if hit.any():
                rows, w = p[hit], w[hit]
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                dots = np.add.reduceat(self.weights[own[hit]] * w[:, None], starts, axis=0)
                top = np.maximum(top, (dots / np.maximum(1e-12, length[rows[starts]])[:, None]).max(axis=0))
        if (top[~self.reserved] >= COSINE).any():
            top[self.reserved] = 0
        j = int(top.argmax())
        return self.names[j], min(1.0, float(top[j]))


def frequencies(files: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed inverse document frequency of every feature over all files."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(FEATURES + 16)
        for pdf in batches:
            for t in pdf["_text"]:
                total[np.unique(word_hashes(t) & np.uint32(FEATURES - 1))] += 1
            total[FEATURES] += len(pdf)
        yield pieces(total)

    df = added(files.select(F.col(text_col).alias("_text")).mapInPandas(count, PIECES))
    df = df if len(df) else np.zeros(FEATURES + 16)
    return np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1


def directory(path: Column) -> Column:
    """Directory of a path, the empty string at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (path, own_license, own_score, ...) with ``license`` and ``inherited_from``.

    A file's own licence counts first; else that of the nearest directory at or above it that has a licence file with a
    licence (of several the best score, then the smallest name). A null path inherits nothing.
    """
    found = files.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(directory(F.col("path")).alias("_dir")).agg(
        F.min_by("own_license", F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("_license"))
    dirs = files.select(directory(F.col("path")).alias("_at")).where(F.col("_at").isNotNull()).distinct()
    parts = F.split("_at", "/")
    ups = dirs.select("_at", F.explode(F.sequence(F.lit(0), F.when(F.col("_at") == "", 0).otherwise(F.size(parts)))).alias("_depth"))
    ups = ups.withColumn("_dir", F.array_join(F.slice(F.split("_at", "/"), F.lit(1), F.col("_depth")), "/"))
    near = ups.join(found, "_dir").groupBy("_at").agg(F.max_by(F.struct("_license", "_dir"), F.col("_depth")).alias("_near"))
    out = files.withColumn("_in", directory(F.col("path"))).join(near, F.col("_in") == F.col("_at"), "left")
    own = F.col("own_license").isNotNull()
    return out.select(*[F.col(c) for c in files.columns], F.coalesce("own_license", "_near._license").alias("license"),
                      F.when(~own, F.col("_near._dir")).alias("inherited_from"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "id", path_col: str = "path",
         text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """(id, path, own_license, own_score, license, inherited_from) per row of ``files``.

    Null and empty texts have no licence of their own but may inherit one. Repeated rows keep a row each; an empty table
    gives an empty result; other columns are not read. Whole texts are compared, whatever their length.
    """
    idf = frequencies(files, text_col)
    shared = files.sparkSession.sparkContext.broadcast(Matcher.of(idf, templates))  # 2^18 numbers and the given templates

    @F.pandas_udf("name string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.best(t) for t in texts], columns=["name", "score"])

    own = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), best(F.col(text_col)).alias("_b"))
    own = own.select("id", "path", F.when(F.col("_b.score") >= cosine, F.col("_b.name")).alias("own_license"), F.col("_b.score").alias("own_score"))
    return inherit(saved(own))


def document_path(doc_id: Column, source: Column) -> Column:
    """Documents as files: source / hundred / ten / id, where the first of a ten, and of a hundred, is the licence file."""
    hundred, ten = F.floor(doc_id / 100), F.floor(doc_id / 10)
    folder = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.concat(F.lit("g"), hundred.cast("string")))
    return F.when(doc_id % 100 == 0, F.concat(folder, F.lit("/LICENSE"))).when(
        doc_id % 10 == 0, F.concat(folder, F.lit("/t"), ten.cast("string"), F.lit("/LICENSE"))).otherwise(
        F.concat(folder, F.lit("/t"), ten.cast("string"), F.lit("/"), doc_id.cast("string"), F.lit(".txt")))


@query("op3_license_scan")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")
