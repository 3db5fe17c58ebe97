"""Licence notices in texts, by a positional index of rare words.

The index holds the words of every notice (template) with their places in
it.  Words are weighed by their document frequency over all documents; a
file's words are looked up only where they are among the rarest of a
template.  Each such word at place i that stands at place q of a template
proposes that the template begins at i - q; places on which two words
agree are checked word by word.  A template stands at a place if at least
``share`` of its words are there, all words of its key phrases among them,
and the whole template lies inside the text.

Nothing is lost by looking at rare words alone: a template of m words that
may differ in e of them is looked up by its e + 2 rarest places, of which
a text that holds it has at least two.

Phrases are templates without any word to spare.  Label, places and score
(the largest share of any template found, 1 for a phrase, 0 without one)
are counted over whole texts.

Defined cases: a null or empty text has no words and no label; repeated
rows and ids are judged row by row; equally rare places go to the first in
the template; an empty table gives an empty result; other columns pass
through unread, and of the names in ``OUT`` theirs is replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestream import Chunk, chunks, word_bounds, word_codes
from .columns import text_or_empty

SHARE = 0.8
OUT = ("n_words", "places")

# Bytes of words: 0-9, a-z (texts are lower-cased), non-ASCII characters.
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Notice(NamedTuple):
    """A licence notice; ``keys`` are phrases that must stand word by word."""
    label: str
    text: str
    keys: tuple[str, ...]
    share: float = SHARE


#: Phrases that are found as such.
PHRASES = (
    Notice("mit", "mit license", ("mit license",), 1.0),
    Notice("apache", "apache license", ("apache license",), 1.0),
    Notice("gpl", "general public license", ("general public license",), 1.0),
)

#: Notices as their licences ask for them.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Notice("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
                         "license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction",
           ("deal in the software without restriction",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                  "hereby granted", ("distribute this software", "with or without fee")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
                  "that the following conditions are met", ("source and binary forms",)),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3",
           ("gnu general public license version 3",)),
    Notice("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as "
                      "published by the free software foundation either version 3 of the license",
           ("gnu general public license", "version 3")),
    Notice("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as "
                      "published by the free software foundation either version 2 of the license",
           ("gnu general public license", "version 2")),
    Notice("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                   "published by the free software foundation", ("gnu lesser general public license",)),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
           ("mozilla public license v 2 0",)),
    Notice("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
           ("creative commons attribution 4 0",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain",
           ("free and unencumbered software", "public domain")),
)


class Index:
    """Postings of the templates; word codes stand for words."""

    def __init__(self, notices):
        self.notices = notices
        split = [n.text.split() for n in notices]
        vocabulary = sorted({w for ws in split for w in ws})
        c = next(chunks(pa.array(vocabulary)))
        codes = word_codes(c, c.offsets[:-1], c.offsets[1:])
        order = np.argsort(codes)
        self.codes, number = codes[order], {vocabulary[i]: k for k, i in enumerate(order)}
        self.words = [np.array([number[w] for w in ws]) for ws in split]
        self.must = [np.array(sorted({i + k for key in n.keys for i in _places(ws, key.split())
                                      for k in range(len(key.split()))}), np.int64) for n, ws in zip(notices, split)]
        self.need = [math.ceil(n.share * len(ws) - 1e-9) for n, ws in zip(notices, split)]
        self.post = None

    def weigh(self, df: np.ndarray) -> "Index":
        """Choose every template's rarest places by document frequency."""
        posts = []
        for t, ws in enumerate(self.words):
            probes = min(len(ws), len(ws) - self.need[t] + 2)
            for q in sorted(range(len(ws)), key=lambda q: (df[ws[q]], q))[:probes]:
                posts.append((ws[q], t, q))
        word, t, q = np.array(sorted(posts), np.int64).T
        self.post = np.searchsorted(word, np.arange(len(self.codes) + 1)), t, q
        return self

    def numbers(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(number of every word, -1 outside the vocabulary; its text)."""
        start, end, row = word_bounds(c, _GAP)
        codes = word_codes(c, start, end)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1), row

    def find(self, v: np.ndarray, row: np.ndarray, first: np.ndarray):
        """(template, place, words found) of every template that stands in
        a text, by place; ``first``: the first word of each text and the end."""
        starts, t, q = self.post
        rare = np.flatnonzero(v >= 0)
        rare = rare[starts[v[rare] + 1] > starts[v[rare]]]
        n = starts[v[rare] + 1] - starts[v[rare]]
        at = np.repeat(starts[v[rare]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i = np.repeat(rare, n)
        begin, t = i - q[at], t[at]
        size = np.array([len(w) for w in self.words])
        fits = (begin >= first[row[i]]) & (begin + size[t] <= first[row[i] + 1])
        key, agree = np.unique(begin[fits] * len(self.words) + t[fits], return_counts=True)
        key = key[agree >= np.minimum(2, size[key % len(self.words)])]
        begin, t = key // len(self.words), key % len(self.words)
        out = []
        for k in np.unique(t):
            b = begin[t == k]
            same = v[b[:, None] + np.arange(size[k])] == self.words[k]
            found = same.sum(1)
            good = (found >= self.need[k]) & same[:, self.must[k]].all(1)
            out.append(np.stack([np.full(good.sum(), k), b[good], found[good]], 1))
        res = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return res[np.lexsort((res[:, 0], res[:, 1]))].T


def _places(words: list[str], key: list[str]) -> list[int]:
    return [i for i in range(len(words) - len(key) + 1) if words[i:i + len(key)] == key]


def document_frequencies(texts: DataFrame, index: Index) -> np.ndarray:
    """In how many texts each word of the templates stands."""
    size = len(index.codes)

    def task(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                v, row = index.numbers(c)
                pair = np.unique(row[v >= 0] * size + v[v >= 0])
                sums += np.bincount(pair % size, minlength=size)
        yield pa.record_batch({"word": pa.array(np.arange(size)), "df": pa.array(sums)})

    out = np.zeros(size, np.int64)
    # one row per word of the fixed templates
    for r in texts.mapInArrow(task, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect():
        out[r["word"]] = r["df"]
    return out


def license_places(docs: DataFrame, text: str = "text", notices=PHRASES + NOTICES) -> DataFrame:
    """All columns of ``docs`` but the text, with n_words and places:
    (template number, label, first word, words, share) by first word."""
    kept = [f for f in docs.schema.fields if f.name not in (text, *OUT)]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], text_or_empty(F.col(text)).alias("__text"))
    index = Index(notices)
    index.weigh(document_frequencies(rows.select("__text"), index))
    label = np.array([n.label for n in notices])
    size = np.array([len(w) for w in index.words])

    def task(batches):
        for batch in batches:
            for c in chunks(batch.column("__text")):
                v, row = index.numbers(c)
                first = np.searchsorted(row, np.arange(c.n + 1))
                t, begin, found = index.find(v, row, first)
                of = row[begin]
                places = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(c.n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array(t.astype(np.int32)), pa.array(label[t].tolist(), pa.string()), pa.array(begin - first[of]),
                         pa.array(size[t]), pa.array(found / size[t])], ["template", "label", "start", "words", "share"]))
                rest = {k: batch.column(k).slice(c.first, c.n) for k in batch.schema.names if k != "__text"}
                yield pa.record_batch({**rest, "n_words": pa.array(np.diff(first)), "places": places})

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(task, schema + "n_words bigint, places array<struct<template:int,label:string,start:bigint,"
                                          "words:bigint,share:double>>")


def license_report(docs: DataFrame) -> DataFrame:
    """Contract columns of query ``op12``."""
    found = license_places(docs.select("doc_id", "text"))
    base = F.filter("places", lambda p: p["template"] < len(PHRASES))
    names = lambda arr: F.array_join(F.array_sort(F.array_distinct(F.transform(arr, lambda p: p["label"]))), ",")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
