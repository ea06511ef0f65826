"""License scans by diagonal voting.

Every run of ``K`` words of every document is hashed and joined by Spark to the
positions of that run in the license templates.  A match of template position
t at document word p votes for the diagonal p - t.  Votes are summed per
(document, template, diagonal), neighbouring diagonals are merged, so that an
inserted or missing word does not break a match, and a merged span is accepted
when its distinct template positions cover enough of the template.

Phrases are templates that must match whole and on one diagonal; K is 2, the
length of the shortest of them.  The templates are a fixed list of this module
or a parameter; what is broadcast is one row for each of their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.text import grams, small_batches, words_of

K = 2
#: Diagonals at most so far apart are merged.
NEAR = 2
#: The least share of a template's runs that a span must hold.
COVER = 0.7

#: Phrase and label.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Notice and label, sentences from the public license texts.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Released under the MIT License": "mit",
    "Licensed under the Apache License, Version 2.0": "apache",
    "you may not use this file except in compliance with the License": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "This work is licensed under the GNU General Public License, version 3": "gpl",
    "GNU Lesser General Public License": "lgpl",
    "GNU Affero General Public License": "agpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Mozilla Public License Version 2.0": "mpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Creative Commons Attribution-NonCommercial": "cc-by-nc",
    "Creative Commons Attribution-ShareAlike": "cc-by-sa",
    "This is free and unencumbered software released into the public domain": "unlicense",
}

_SCHEMA = "rid long, doc_id long, n_words long, pos long, gram long"


def _runs(k: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = np.asarray(batch.column(0).to_pandas().fillna(0), dtype=np.int64)
            null = np.asarray(batch.column(0).is_null())
            for a, b, words in words_of(batch.column(1)):
                h, first, of_text = grams(words, k)
                runs = np.diff(of_text)
                # a text's first row holds no run and stands for the text itself
                at = of_text[:-1] + np.arange(b - a)
                row = np.ones(len(h) + b - a, dtype=bool)
                row[at] = False
                text = np.repeat(np.arange(b - a), runs + 1)
                pos = np.full(len(row), -1)
                pos[row] = first - words.of_text[text[row]]
                gram = np.zeros(len(row), np.uint64)
                gram[row] = h
                columns = [
                    pa.array(rid + text), pa.array(ids[a:b][text], mask=null[a:b][text]), pa.array(words.count[text]),
                    pa.array(pos), pa.array(gram.view(np.int64), mask=~row),
                ]
                rid += b - a
                whole = pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_words", "pos", "gram"])
                for i in range(0, len(row), 200_000):
                    yield whole.slice(i, 200_000)

    return scan


def templates(spark, phrases: dict[str, str], notices: dict[str, str], k: int = K) -> DataFrame:
    """tid, base, label, runs, tpos, gram: one row for each run of each template."""
    rows = []
    for tid, (text, label, base) in enumerate([*((t, v, True) for t, v in phrases.items()), *((t, v, False) for t, v in notices.items())]):
        _, _, words = next(words_of(pa.array([text])))
        h, _, _ = grams(words, k)
        if not len(h):
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(tid, base, label, len(h), i, int(x)) for i, x in enumerate(h.view(np.int64))]
    return spark.createDataFrame(rows, "tid int, base boolean, label string, runs int, tpos int, gram long")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each span found and one for each document (tid null): rid, doc_id, n_words, tid, base, label, first, last, cover.

    first and last are the span's words, from 0, the last inclusive; cover is
    the share of the template's runs that the span holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    runs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_runs(K), _SCHEMA)
    votes = runs.join(F.broadcast(known), "gram", "left").filter(F.col("pos").eqNullSafe(-1) | F.col("tid").isNotNull())
    votes = votes.withColumn("diag", F.col("pos") - F.col("tpos"))
    lines = votes.groupBy("rid", "tid", "diag").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("base").alias("base"), F.max("label").alias("label"), F.max("runs").alias("runs"),
        F.min("pos").alias("first"), F.max("pos").alias("end"), F.collect_set("tpos").alias("held"),
    )
    along = Window.partitionBy("rid", "tid").orderBy("diag")
    apart = F.col("base") | F.lag("diag").over(along).isNull() | (F.col("diag") - F.lag("diag").over(along) > NEAR)
    lines = lines.withColumn("island", F.sum(F.when(apart, 1).otherwise(0)).over(along))
    spans = lines.groupBy("rid", "tid", "island").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("base").alias("base"), F.max("label").alias("label"),
        F.min("first").alias("first"), (F.max("end") + K - 1).alias("last"), (F.size(F.array_distinct(F.flatten(F.collect_list("held")))) / F.max("runs")).alias("cover"),
    )
    true = F.when(F.col("base"), F.col("cover") == 1.0).otherwise(F.col("cover") >= COVER)
    return spans.filter(F.col("tid").isNull() | true).drop("island")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: words, phrase places, labels and a score.

    Null and empty texts have no words, no labels and score 0.  The score is
    the best cover of a template.  Repeated ids and rows each get a row; other
    columns are ignored; an empty table gives no rows.
    """
    spans = scan(docs, **options)

    def names(which) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return spans.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("base"), 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.lit(True)).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("rid")
