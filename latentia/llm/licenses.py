"""Operator 12: license scans by an exact set-similarity join of text blocks with templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased: ASCII letters, digits and everything
outside ASCII.  A template is a set of words; its width is the least power of two, 8 at least, that is not below its number
of words.  The blocks of a text for a width are the runs of 2 * width words that start every width words, so each passage as
long as a template lies whole in a block, wherever lines break.  A block matches a template if it holds at least
``ceil(threshold * size)`` of the template's distinct words.

The join is exact.  The words of all templates are counted over all texts and ordered from the rarest to the most frequent;
only these can overlap, so a block is its set of them.  With ``need`` words asked for,

* prefix filter: one of the first ``size - need + 1`` words of the template stands in the block,
* length filter: the block holds at least ``need`` template words at all,
* positional filter: after the first common word both sides have enough words left for ``need``,

and what passes is counted on whole sets.  Templates are a parameter, so their index is bounded by it and travels with the
tasks; texts are read where they are and nothing but word counts is shuffled.

Besides blocks, the base phrases are found where their words stand consecutively.

Defined cases: a null text is empty; a text without words has no blocks, score 0 and empty labels; repeated rows and null
ids give a row each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import slices

#: Phrases and labels of the base, and the opening or naming words of well-known license notices.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = Fraction(9, 10)
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCANNED = (
    "doc_id long, n_words long, base array<struct<label:string,start:long>>, "
    "blocks array<struct<label:string,template:int,start:long,stop:long,overlap:int,size:int>>"
)


def words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(TO_WORDS).split()


class Template(NamedTuple):
    label: str
    tokens: list[int]  # ranks in the global order, ascending: rarest first
    need: int
    width: int


class Index(NamedTuple):
    rank: dict[bytes, int]  # of template and phrase words
    templates: list[Template]
    prefix: dict[int, list[tuple[int, int]]]  # rank -> (template, place in it) for the words of prefixes
    phrases: list[tuple[str, list[int]]]


def width_of(size: int) -> int:
    return max(8, 1 << (size - 1).bit_length())


def vocabulary(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[bytes]:
    return sorted({w for _, text in (*templates, *phrases) for w in words(text.encode())})


def index_of(counts: dict[bytes, int], templates: tuple[tuple[str, str], ...], threshold: Fraction, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Index:
    order = sorted(vocabulary(templates, phrases), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    made, prefix = [], {}
    for t, (label, text) in enumerate(templates):
        row = words(text.encode())
        tokens = sorted({rank[w] for w in row})
        need = max(math.ceil(threshold * len(tokens)), 1)
        made.append(Template(label, tokens, need, width_of(len(row))))
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            prefix.setdefault(token, []).append((t, i))
    return Index(rank, made, prefix, [(label, [rank[w] for w in words(text.encode())]) for label, text in phrases])


def ranks_of(raw: bytes | None, rank: dict[bytes, int]) -> np.ndarray:
    """The rank of every word of a text, -1 for words of no template."""
    row = words(raw)
    return np.fromiter(map(rank.get, row, repeat(-1)), np.int32, len(row))


def phrase_places(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = ids[:n] == phrase[0]
    for i, w in enumerate(phrase[1:], 1):
        hit &= ids[i : i + n] == w
    return np.flatnonzero(hit)


def matching_blocks(ids: np.ndarray, index: Index, is_prefix: np.ndarray) -> list[tuple[int, int, int]]:
    """(template, first word of the block, overlap) of every block and template at or above the threshold."""
    found, sets, last = [], {}, {}
    candidates = set()
    for p in np.flatnonzero(is_prefix[ids]).tolist():
        for t, _ in index.prefix[int(ids[p])]:
            w = index.templates[t].width
            top = last.setdefault(w, max(-(-len(ids) // w) - 2, 0))
            candidates.update((t, b) for b in (p // w - 1, p // w) if 0 <= b <= top)
    for t, b in sorted(candidates):
        label, tokens, need, w = index.templates[t]
        block = sets.get((w, b))
        if block is None:
            part = ids[b * w : (b + 2) * w]
            block = sets[w, b] = np.unique(part[part >= 0]).tolist()
        if len(block) < need:
            continue
        place = {x: j for j, x in enumerate(block)}
        i = next((i for i, x in enumerate(tokens) if x in place), None)
        if i is None or 1 + min(len(tokens) - i - 1, len(block) - place[tokens[i]] - 1) < need:
            continue
        overlap = sum(x in place for x in tokens[i:])
        if overlap >= need:
            found.append((t, b * w, overlap))
    return found


def word_counts(texts: DataFrame, vocab: list[bytes]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; as many numbers as templates have words."""
    rank = {w: i for i, w in enumerate(vocab)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocab) + 1, np.int64)
        for batch in batches:
            for raw in batch.column("text"):
                seen += np.bincount(ranks_of(raw.as_py(), rank) + 1, minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocab)), pa.int32()), pa.array(seen[1:])], names=["w", "n"])

    rows = texts.select("text").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {vocab[r["w"]]: r["n"] for r in rows}


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (label, start of each phrase), blocks (label, template, start, stop, overlap, size of each match).

    start and stop count words from 0; a block's stop is cut to the text's end.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    index = index_of(word_counts(own, vocabulary(templates)), templates, threshold)
    flags = np.zeros(len(index.rank) + 1, bool)  # the last answers for -1
    flags[list(index.prefix)] = True
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    block_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("overlap", pa.int32()), ("size", pa.int32())]))

    def one(raw: bytes | None) -> tuple[int, list[dict], list[dict]]:
        ids = ranks_of(raw, index.rank)
        base = [{"label": label, "start": p} for label, phrase in index.phrases for p in phrase_places(ids, phrase).tolist()]
        blocks = []
        for t, start, overlap in matching_blocks(ids, index, flags):
            of = index.templates[t]
            blocks.append({"label": of.label, "template": t, "start": start, "stop": min(start + 2 * of.width, len(ids)), "overlap": overlap, "size": len(of.tokens)})
        return len(ids), base, blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, base, blocks = zip(*[one(raw) for raw in batch.column("text").to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, base_type), pa.array(blocks, block_type)], names=["doc_id", "n_words", "base", "blocks"])

    return own.mapInArrow(run, SCANNED)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    score: 1 where a base phrase stands (it is held whole), else the greatest share of a template in a block that matches it, else 0.
    """
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts, found = F.col("base.start"), F.col("blocks")
    best = F.array_max(F.transform(found, lambda b: b["overlap"] / b["size"]))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"),
        listed(F.concat(F.col("base.label"), F.col("blocks.label"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def sql() -> str:
    """The same rows by brute force: every block against every template of its width."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        row = text.split()
        listed = ", ".join(f"'{w}'" for w in sorted(set(row)))
        rows.append(f"({t}, '{label}', {width_of(len(row))}, {math.ceil(THRESHOLD * len(set(row)))}, [{listed}])")
    phrase = "\n          UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS start FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {j}] = '{w}'" for j, w in enumerate(text.split())) for label, text in PHRASES
    )
    return f"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM documents
        ), t(template, label, width, need, tokens) AS (VALUES {", ".join(rows)}
        ), base AS (
          {phrase}
        ), cut AS (
          SELECT r, width, unnest(range(0, greatest(CAST(ceil(len(w) / width) AS BIGINT) - 1, 1))) * width AS start, w FROM d, (SELECT DISTINCT width FROM t)
        ), met AS (
          SELECT cut.r, t.label, len(list_intersect(t.tokens, w[start + 1 : start + 2 * cut.width])) AS overlap, len(t.tokens) AS size, need
          FROM cut JOIN t ON cut.width = t.width
        ), blocks AS (SELECT * FROM met WHERE overlap >= need
        ), b AS (
          SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r
        ), a AS (
          SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM blocks) GROUP BY r
        ), s AS (SELECT r, max(CAST(overlap AS DOUBLE) / size) AS best, count(*) AS n_blocks FROM blocks GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
          coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
        FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN s USING (r)
    """
