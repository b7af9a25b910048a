"""Licence notices in paragraphs: a sparse word n-gram logistic regression, an unknown class and a template check.

Only DataFrame functions touch the documents: paragraphs become word uni- and bigrams, a join with the (small, fixed) table
of learned weights sums their logits, a softmax with a fitted temperature gives probabilities, and the words of the family's
templates confirm a prediction. The weights are learned on the driver from the notice templates below, shortened and mixed
at random, against a bounded draw of paragraphs of the documents themselves.

Defined results
* a paragraph is a line, or a line with lines that follow it in its block (lines without words end blocks), so notices may be
  wrapped at any width; null text and empty lines have none;
* a paragraph whose best class is a family with probability of at least `sure`, and whose words cover the share `cover` of
  one of the family's templates, is a notice of that family, if none of that family lies inside it; those of a family that
  overlap count once. A line that is like a notice otherwise, and in none, is `unknown`;
* every document row gives a row: families (sorted, comma-joined, `` if none), n_notices, n_unknown, top_score;
* repeated rows and a null doc_id give the results of their own text; an empty table gives an empty result; other columns
  are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

#: Short notices by family.
TEMPLATES = {
    "agpl": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license", "released under the apache license version 2.0"],
    "bsd": ["licensed under the bsd 3-clause license", "redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "gpl": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "you can redistribute it and/or modify it under the terms of the gnu general public license"],
    "isc": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "licensed under the gnu lesser general public license version 3", "released under the gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at", "this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license version 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
#: Notices of no listed family teach the unknown class.
UNLISTED = ["licensed under the acme source license", "released under our own terms of use", "this file is covered by the vendor license agreement", "all rights reserved see the license file for terms", "licensed under a proprietary license version 1"]
#: Sentences that speak of licences, rights or permission and are no notices.
HARD_NEGATIVES = [
    "he lost his driving license on the way home", "you need permission from the city to park here", "the film is under copyright and cannot be shown in public",
    "a license to operate the plant was granted in march", "the software asks for permission before it reads your files", "the museum released a free version of the map under pressure",
    "the general public was not admitted without a license", "her fishing license expired in version 2 of the story", "the apache people lived in the southwest", "he studied at mit and released a book",
    "the source of the river is subject to the terms of the treaty", "the foundation published a free program of concerts", "redistribution of wealth is permitted by law",
]
NONE, UNKNOWN = "none", "unknown"
CLASSES = (NONE, UNKNOWN, *sorted(TEMPLATES))
#: Bounds of the fit: paragraphs drawn as examples of no notice, random variants of each template, smallest weight kept.
NONE_ROWS, VARIANTS, EPOCHS, RATE, LEAST_WEIGHT = 2000, 24, 150, 2.0, 0.02
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
SURE, COVER = 0.6, 0.75
#: Words of the longest template; a paragraph ends with the line that brings the words after its first line to so many.
LONGEST = max(len(t.split()) for ts in TEMPLATES.values() for t in ts)


def grams_of(text: str) -> list[str]:
    words = [w for w in re.split(r"[^a-z0-9.]+", text.lower()) if w.strip(".")]
    words = [w.strip(".") for w in words]
    return sorted(set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])})


def words_column(line):
    """The words of a paragraph: runs of a-z, 0-9 and inner points."""
    return F.filter(F.transform(F.split(F.lower(line), "[^a-z0-9.]+"), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def grams_column(words):
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


@dataclass
class Model:
    """Gram -> weight of each class, class biases, temperature, and word parts one of which every feature holds.

    `reliability` is the expected calibration error on templates that the temperature's fit had not seen: the mean gap between
    stated probability and share of right answers over ten bins.
    """

    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    cues: list[str]
    reliability: float


def _variants(rng, text: str, n: int):
    words = text.split()
    yield text
    for _ in range(n):
        keep = [w for w in words if rng.random() > 0.12]
        yield " ".join((["the"] if rng.random() < 0.2 else []) + (keep or words))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _regression(r, c, y, rows: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent over the chosen rows of the cells (r, c), classes weighing alike."""
    goal, n = np.eye(len(CLASSES))[y], len(y)
    share = (rows / np.bincount(y, weights=rows, minlength=len(CLASSES))[y].clip(1))[:, None] / len(CLASSES)
    w, b = np.zeros((n_features, len(CLASSES))), np.zeros(len(CLASSES))
    b[0] = 3.0
    for _ in range(EPOCHS):
        z = np.tile(b, (n, 1))
        np.add.at(z, r, w[c])
        d = (_softmax(z) - goal) * share
        g = np.zeros_like(w)
        np.add.at(g, c, d[r])
        w -= RATE * (g + 1e-4 * w)
    return w, b


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[at == k].sum() - right[at == k].sum()) for k in range(bins)) / max(1, len(y)))


def train(nothing: list[str], seed: int = 3) -> Model:
    """Multinomial logistic regression on variants of the templates, on sentences that only sound like notices, and on lines
    of the documents.

    The temperature is fitted on templates that a first regression has not seen (one of each family that has several, a fifth
    of the other examples); the weights are then learned from all. Only grams with a word that the documents' lines lack are
    features, so a paragraph without any has the biases for logits, and these say `none`.
    """
    rng = np.random.default_rng(seed)
    rows, unseen = [(0, t) for t in nothing], [bool(rng.random() < 0.2) for _ in nothing]
    for k, name in enumerate(CLASSES):
        known = UNLISTED if name == UNKNOWN else HARD_NEGATIVES if name == NONE else TEMPLATES[name]
        for i, t in enumerate(known):
            made = [(k, v) for v in _variants(rng, t, VARIANTS)]
            rows += made
            unseen += [i == len(known) - 1 and len(known) > 1] * len(made)
    common = {w for t in nothing for w in grams_of(t) if " " not in w}
    names = sorted({g for k, t in rows if k for g in grams_of(t) if set(g.split()) - common})
    at = {g: i for i, g in enumerate(names)}
    cells = [(r, at[g]) for r, (_, t) in enumerate(rows) for g in grams_of(t) if g in at]
    r, c = np.array(cells, np.int64).reshape(-1, 2).T
    y, test = np.array([k for k, _ in rows]), np.array(unseen)
    w, b = _regression(r, c, y, (~test).astype(float), len(names))
    z = np.tile(b, (len(rows), 1))
    np.add.at(z, r, w[c])
    z, truth = z[test], y[test]
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in TEMPERATURES} if len(z) else {1.0: 0.0}
    temperature = min(loss, key=loss.get)
    error = calibration_error(_softmax(z / temperature), truth) if len(z) else 0.0
    w, b = _regression(r, c, y, np.ones(len(rows)), len(names))
    kept = {g: w[i].round(6).tolist() for g, i in at.items() if np.abs(w[i]).max() >= LEAST_WEIGHT}
    telling = {w for g in kept for w in g.split()} - common
    cues = sorted({max((p for p in w.split(".") if p), key=len) for w in telling})
    return Model(kept, b.tolist(), temperature, cues, error)


def fit(docs: DataFrame, none_rows: int = NONE_ROWS) -> Model:
    """Learn with a bounded draw of paragraphs that name no licence as examples of no notice."""
    n = docs.where("doc_id is not null and text is not null").count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, none_rows / max(1, n)) * (1 << 20)).select("doc_id", F.split("text", "\n").alias("all"))
    line = F.try_element_at("all", (F.pmod(F.xxhash64(F.lit("line"), F.col("doc_id")), F.size("all")) + 1).cast("int"))
    lines = drawn.where("all is not null").select(line.alias("line")).where(~F.lower("line").rlike("licen|copyright|permission")).collect()
    return train(sorted(x["line"] for x in lines))


def _row_key():
    """128 bits of id and text: rows with equal keys are repeated rows, and have equal results."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit("second"), F.col("text"), F.col("doc_id")).alias("b"))


def scan(docs: DataFrame, model: Model, sure: float = SURE, cover: float = COVER, only_cued: bool = True) -> DataFrame:
    """documents (doc_id, text) -> doc_id, families, n_notices, n_unknown, top_score.

    `only_cued` leaves texts and lines out that hold no part of any feature; it changes the work, not the result.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text").withColumn("row_key", _row_key())
    # every feature holds a cue, so texts and then lines without one can't score; the n-grams of the others are made
    cued = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in model.cues])) if only_cued else F.lit(True)
    split = base.where(F.col("text").isNotNull() & cued("text")).select("row_key", F.split("text", "\n").alias("all")).withColumn("cued", F.transform("all", cued))
    lines = split.select("row_key", "all", "cued", F.explode(F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.exists(F.slice("cued", i + 1, LONGEST + 1), lambda c: c))).alias("pos"))
    # each line has a word, so LONGEST lines that follow hold LONGEST words
    ahead = lines.select("row_key", "pos", F.slice("cued", F.col("pos") + 1, LONGEST + 1).alias("cued"), F.transform(F.slice("all", F.col("pos") + 1, LONGEST + 1), words_column).alias("words"))
    ahead = ahead.where(F.size(F.col("words")[0]) > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("n"))
    inner = F.flatten(F.slice("words", F.lit(2), F.greatest(F.col("n") - 2, F.lit(0))))
    whole = F.forall(F.slice("words", F.lit(1), F.col("n")), lambda w: F.size(w) > 0) & F.exists(F.slice("cued", F.lit(1), F.col("n")), lambda c: c)
    paragraphs = ahead.where((F.size(inner) < LONGEST) & whole).select("row_key", "pos", "n", F.flatten(F.slice("words", F.lit(1), F.col("n"))).alias("words"))
    table = spark.createDataFrame([(g, w) for g, w in sorted(model.weights.items())], "gram string, w array<double>")
    grams = paragraphs.select("row_key", "pos", "n", "words", F.explode(grams_column(F.col("words"))).alias("gram"))
    # few paragraphs hold a feature; only these go on. Repeated rows have equal keys and count once
    hits = grams.join(F.broadcast(table), "gram").dropDuplicates(["row_key", "pos", "n", "gram"])
    sums = hits.groupBy("row_key", "pos", "n").agg(F.first("words").alias("words"), *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(CLASSES))])
    logits = [(F.col(f"s{k}") + model.bias[k]) / model.temperature for k in range(len(CLASSES))]
    scored = sums.select("row_key", "pos", "n", "words", F.array(*logits).alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("mass", F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top"))))
    scored = scored.select("row_key", "pos", "n", grams_column(F.col("words")).alias("grams"), (F.array_position(F.col("z"), F.col("top")) - 1).cast("int").alias("class"), (F.lit(1.0) / F.col("mass")).alias("score")).where(F.col("class") > 0)
    templates = spark.createDataFrame([(CLASSES.index(name), grams_of(t)) for name, ts in TEMPLATES.items() for t in ts], "class int, template array<string>")
    share = F.size(F.array_intersect("grams", "template")) / F.size("template")
    judged = scored.join(F.broadcast(templates), "class", "left").groupBy("row_key", "pos", "n", "class", "score").agg(F.max(F.coalesce(share, F.lit(0.0))).alias("share"))
    family = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("class") + 1)
    sure_of = (F.col("class") > 1) & (F.col("score") >= sure) & (F.col("share") >= cover)
    last = (F.col("pos") + F.col("n") - 1).alias("last")
    named = judged.select("row_key", "pos", "n", last, "score", F.when(sure_of, family).alias("family")).where((F.col("n") == 1) | F.col("family").isNotNull())
    # by last line: what begins no later than an earlier one begins holds that one
    ends = Window.partitionBy("row_key", "family").orderBy("last", F.desc("pos"))
    least = F.coalesce(F.max("pos").over(ends.rowsBetween(Window.unboundedPreceding, -1)) < F.col("pos"), F.lit(True))
    reach = F.max(F.when(F.col("family").isNotNull(), F.col("last"))).over(Window.partitionBy("row_key").orderBy("pos"))
    named = named.withColumn("least", F.col("family").isNotNull() & least).withColumn("inside", F.coalesce(reach >= F.col("pos"), F.lit(False)))
    named = named.where(F.col("least") | (F.col("family").isNull() & ~F.col("inside")))
    named = named.withColumn("first", F.coalesce(F.lag("last").over(ends) < F.col("pos"), F.lit(True)))
    found = named.groupBy("row_key").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count(F.when(F.col("first"), F.col("family"))).alias("n_notices"), (F.count("*") - F.count("family")).alias("n_unknown"), F.max("score").alias("top_score"))
    return base.select("doc_id", "row_key").join(found, "row_key", "left").select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"))
