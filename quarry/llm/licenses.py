"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Whole texts are scanned window by window (each run of one, two and four lines), as headers and
notices stand anywhere in a file and are often wrapped. Windows and
templates become sparse TF-IDF vectors over the templates' terms; a file's licence is
that of the template with the highest cosine, from a threshold on. Document frequencies are counted
over all files, for the templates' terms only (their number is fixed by the templates).

A licence found in a licence file (by its name) holds for its directory. Every other file without a licence
of its own takes that of the nearest ancestor directory with one: distinct directories are
exploded into their ancestors and joined by path.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import text_pieces
from quarry.session import ensure_checkpoint_dir

#: Notices by which public licences are stated in headers and licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Proprietary", "All rights reserved."),
)
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"
THRESHOLD = 0.75
_TERM = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class TemplateIndex:
    """The templates as rows of unit TF-IDF vectors over their own terms."""

    def __init__(self, templates, frequency: dict[str, int], n_files: int):
        self.names = [name for name, _ in templates]
        found = [Counter(terms(text)) for _, text in templates]
        self.at = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        self.idf = np.zeros(len(self.at))
        for t, i in self.at.items():
            self.idf[i] = np.log((n_files + 1) / (frequency.get(t, 0) + 1)) + 1
        self.rows = np.zeros((len(found), len(self.at)))
        for r, counts in enumerate(found):
            for t, c in counts.items():
                self.rows[r, self.at[t]] = c * self.idf[self.at[t]]
        self.rows /= np.sqrt((self.rows ** 2).sum(1))[:, None]
        self.other = np.log(n_files + 1) + 1  # idf of a term that no template has

    def line(self, own: list[str]) -> tuple[np.ndarray, float]:
        """Products of a line's vector with the templates, and its squared norm."""
        dot, norm = np.zeros(len(self.names)), 0.0
        for t, c in Counter(own).items():
            i = self.at.get(t)
            if i is None:
                norm += (c * self.other) ** 2
            else:
                w = c * self.idf[i]
                norm += w * w
                dot += w * self.rows[:, i]
        return dot, norm

    def best(self, text: str, spans: tuple[int, ...] = (1, 2, 4)) -> tuple[str | None, float]:
        """Licence and cosine of the best template over each run of 1, 2 and 4 lines (lines without
        terms left out): notices are often wrapped. Ties go to the earlier template.

        Only runs with a template's term have a product. The lines' products add up to their run's, and their
        squared norms to no more than its, so the sums bound its cosine; a run below the best so far is left out.
        """
        scores, top = np.zeros(len(self.names)), 0.0
        last: deque[list] = deque(maxlen=max(spans))  # terms, whether one is a template's, product and norm
        for piece in text_pieces(text):
            for line in piece.split("\n"):
                own = terms(line)
                if not own:
                    continue
                last.append([own, not self.at.keys().isdisjoint(own), None])
                run = list(last)
                for n in spans:
                    lines = run[-n:]
                    if n > len(run) or not any(hit for _, hit, _ in lines):
                        continue
                    for x in lines:
                        if x[2] is None:
                            x[2] = self.line(x[0])
                    bound = sum(x[2][0] for x in lines).max() / np.sqrt(sum(x[2][1] for x in lines))
                    if bound >= top * (1 - 1e-9):
                        dot, norm = self.line([t for x in lines for t in x[0]])
                        scores = np.maximum(scores, dot / np.sqrt(norm))
                        top = scores.max()
        k = int(scores.argmax())
        return (self.names[k] if scores[k] > 0 else None), float(scores[k])


def scan(files: DataFrame, templates=TEMPLATES, path: str = "path", text: str = "text",
         keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the path), license (best template's) and similarity of each file,
    whatever the similarity; null and 0 where no term of a template occurs."""
    keep = [path] if keep is None else list(keep)
    vocabulary = sorted({t for _, x in templates for t in terms(x)})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, n = frozenset(vocabulary), Counter(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n += 1
                own = set()
                for piece in text_pieces(x or ""):
                    own.update(known.intersection(_TERM.findall(piece.lower())))
                counts.update(own)
        yield pa.RecordBatch.from_pydict({"term": pa.array(["", *counts], pa.string()),
                                          "n": pa.array([n, *counts.values()], pa.int64())})

    counted = files.select(files[text]).mapInArrow(frequencies, "term string, n long")
    frequency = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    index = TemplateIndex(templates, frequency, frequency.pop("", 0))
    frame = files.select(*[files[c] for c in keep], files[text].alias("_source"))
    schema = frame.drop("_source").schema.add("license", "string").add("similarity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.best(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], [*keep, "license", "similarity"])

    return frame.mapInArrow(run, schema)


def license_scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, path: str = "path",
                 text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per file: ``keep`` columns (default: the path), similarity, own_license (null below the threshold),
    license (its own, else the nearest ancestor directory's) and license_dir (that directory; null if
    its own or none).

    Paths are "/"-separated; a file's directory is what stands before its last "/" ("" at the top). Only licence
    files (LICENSE, COPYING, NOTICE, with any suffix) speak for their directory; if several do, the highest
    similarity wins, then the smaller name. A null path belongs to no directory and inherits nothing;
    null and empty texts have no licence of their own; repeated paths are files each; long texts are
    scanned line by line; ties between templates go to the earlier one; an empty table gives no rows.
    """
    ensure_checkpoint_dir(files.sparkSession)
    keep = [path] if keep is None else list(keep)
    found = scan(files.withColumn("_path", files[path]), templates, path, text, [*keep, "_path"])
    own = F.when(F.col("similarity") >= threshold, F.col("license"))
    rows = found.withColumns({
        "own_license": own, "_dir": F.when(F.col("_path").isNotNull(), F.regexp_replace("_path", r"/?[^/]*$", "")),
        "_name": F.regexp_extract("_path", r"[^/]*$", 0)}).drop("license").checkpoint()
    speaks = rows.where(F.col("own_license").isNotNull() & F.col("_name").rlike(LICENSE_FILE))
    of_dir = speaks.groupBy(F.col("_dir").alias("_above")).agg(
        F.max_by("own_license", F.struct("similarity", "own_license")).alias("_inherited")).checkpoint()
    dirs = rows.select("_dir").where("_dir is not null").distinct()
    steps = F.split("_dir", "/")
    above = dirs.withColumn("_above", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))))).distinct()
    nearest = (above.join(of_dir, "_above").groupBy("_dir")
               .agg(F.max(F.struct(F.length("_above").alias("depth"), "_above", "_inherited")).alias("_best")).checkpoint())
    out = rows.join(nearest, "_dir", "left")
    takes = F.col("own_license").isNull()
    return out.select(*keep, "similarity", "own_license",
                      F.when(takes, F.col("_best._inherited")).otherwise(F.col("own_license")).alias("license"),
                      F.when(takes, F.col("_best._above")).alias("license_dir"))
