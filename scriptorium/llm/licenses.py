"""License scans by sentence rules.

Known licence sentences, normalised, have identifiers. A text's sentences are
normalised and mapped to identifiers; the identifiers, in text order, are
matched against licence rules, each an ordered sequence of identifiers that
has to occur in that order. A document is read once, in the scan's own stage;
nothing is shuffled. The tables are constants, so what each task holds is
bounded.

Because notices come both hard-wrapped and on lines of their own, a text is cut
twice: at . ! ? ; and : before white space and at blank lines; and at . ! and ?
before white space and at every line end. Both cuts' hits are merged by
position.

Normal form: A-Z lower-cased; every run of other than digits, a-z and
non-ASCII becomes one space; ends trimmed.

Defined results: null, empty and blank texts have no known sentence; a
sentence that occurs twice is listed twice; texts of any length are read
whole; repeated rows are judged one by one; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import fresh

_OTHER = re.compile(rb"[^0-9a-z\x80-\xff]+")


def normal(sentence: bytes) -> bytes:
    return _OTHER.sub(b" ", sentence.lower()).strip()


#: Ways to name a licence in a one-sentence notice, by SPDX identifier.
NAMES = {
    "MIT": ("the MIT License", "MIT License", "the MIT licence", "MIT"),
    "ISC": ("the ISC License", "ISC License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3", "GPL-3.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "Unlicense": ("the Unlicense",),
}
_SUBJECTS = ("", "This work is", "This project is", "This software is", "This program is", "This library is", "This file is", "This code is", "This document is", "This repository is")
_VERBS = ("licensed under", "released under", "distributed under", "made available under", "available under", "published under")
_ENDS = ("", "the terms of")

#: Sentences of licence texts, by identifier (fixed values; the texts are public).
SENTENCES = {
    "grant-mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "notice-mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "grant-isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "as-is-isc": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "grant-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "source-bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "binary-bsd": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "endorse-bsd": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "header-apache": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "comply-apache": "you may not use this file except in compliance with the License",
    "as-is-apache": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "free-gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "free-gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "redistribute-gpl": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "redistribute-gpl-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "version-gpl-2": "either version 2 of the License, or (at your option) any later version",
    "useful-gpl": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "subject-mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unencumbered": "This is free and unencumbered software released into the public domain",
    "all-rights": "All rights reserved",
}

#: (licence, identifiers in the order in which they must occur).
TEXT_RULES = (
    ("MIT", ("grant-mit", "notice-mit", "as-is-mit")),
    ("ISC", ("grant-isc", "as-is-isc")),
    ("BSD-3-Clause", ("grant-bsd", "source-bsd", "binary-bsd", "endorse-bsd")),
    ("BSD-2-Clause", ("grant-bsd", "source-bsd", "binary-bsd")),
    ("Apache-2.0", ("header-apache", "comply-apache", "as-is-apache")),
    ("GPL-2.0", ("redistribute-gpl", "version-gpl-2", "useful-gpl")),
    ("GPL-3.0", ("redistribute-gpl-3", "useful-gpl")),
    ("MPL-2.0", ("subject-mpl",)),
    ("Unlicense", ("unencumbered",)),
)
#: A licence whose rule holds more of the same text leaves out the smaller one.
STRONGER = {"BSD-2-Clause": "BSD-3-Clause"}


def _dictionary() -> tuple[dict[bytes, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    known = {normal(s.encode()): k for k, s in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            for subject in _SUBJECTS:
                for verb in _VERBS:
                    for end in _ENDS:
                        known.setdefault(normal(f"{subject} {verb} {end} {name}".encode()), f"named-{licence}")
        known[normal(f"SPDX-License-Identifier: {licence}".encode())] = f"tag-{licence}"
    rules = [*TEXT_RULES]
    for licence in NAMES:
        rules += [(licence, (f"named-{licence}",)), (licence, (f"tag-{licence}",))]
    return known, tuple(rules)


KNOWN, RULES = _dictionary()
#: Every known sentence has one of these, so a text without any has no known sentence.
CLUES = (b"licen", b"free", b"public", b"copyright", b"warrant", b"under", b"redistribut", b"permission", b"rights", b"mozilla")
assert all(any(c in s for c in CLUES) for s in KNOWN)

#: The point of "v. 2.0" ends no sentence.
_VERSION = rb"(?!(?<=[^0-9a-z]v\.)[\x20\x09-\x0D]+[0-9])"
_PARAGRAPHS = re.compile(rb"(?<=[.!?;:])" + _VERSION + rb"[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n")
_LINES = re.compile(rb"(?<=[.!?])" + _VERSION + rb"[\x20\x09-\x0D]+|\n")


def recognised(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences of a text, in order."""
    low = text.lower()
    if not any(c in low for c in CLUES):
        return []
    found = {}
    for cut in (_PARAGRAPHS, _LINES):
        at = 0
        for m in cut.finditer(low):
            if name := KNOWN.get(normal(low[at : m.start()])):
                found[(m.start(), name)] = (at, m.start(), name)
            at = m.end()
        if name := KNOWN.get(normal(low[at:])):
            found[(len(low), name)] = (at, len(low), name)
    return [found[k] for k in sorted(found)]


def licences(sequence: list[str]) -> list[str]:
    """The licences whose rules hold, sorted."""
    out = set()
    for licence, rule in RULES:
        rest = iter(sequence)
        if all(k in rest for k in rule):
            out.add(licence)
    return sorted(k for k in out if STRONGER.get(k) not in out)


def _scan(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("sentence", pa.string())]))
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        rest = [(c, f.name) for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != text]
        hits = [recognised(col[i].as_py() or b"") for i in range(len(col))]
        spans = [[{"first": a, "after": b, "sentence": k} for a, b, k in h] for h in hits]
        out = [licences([k for _, _, k in h]) if h else [] for h in hits]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(spans, span), pa.array(out, pa.list_(pa.string()))], names=[*(n for _, n in rest), *names])


def scanned(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the byte spans of known ``sentences`` and the ``licences`` found.

    New names that clash get underscores in front.
    """
    names = fresh(docs.drop(text), "sentences", "licences")
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("sentence", T.StringType())]))
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField(names[0], span), T.StructField(names[1], T.ArrayType(T.StringType()))])
    return docs.withColumn(text, F.col(text).cast("binary")).mapInArrow(lambda b: _scan(b, text, names), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    ids = F.transform("sentences", lambda x: x["sentence"])
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k.decode())}, {quote(v)})" for k, v in KNOWN.items())
    rules = ", ".join(f"({quote(lic)}, {quote('%' + '%'.join(f',{k},' for k in rule) + '%')})" for lic, rule in RULES)
    stronger = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in STRONGER.items())
    norm = r"trim(regexp_replace({}, '[^0-9a-z\x80-\x{{10FFFF}}]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
rules(licence, pattern) AS (VALUES {rules}),
stronger(weak, strong) AS (VALUES {stronger}),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cuts AS (
  SELECT doc_id, regexp_replace(regexp_replace(t, '([.!?;:])([\x20\x09-\x0D]+)', '\1' || chr(1) || '\2' || chr(2), 'g'), '(\n[\x20\x09-\x0D]*\n)', chr(1) || '\1' || chr(2), 'g') AS t FROM low
  UNION ALL
  SELECT doc_id, replace(regexp_replace(t, '([.!?])([\x20\x09-\x0D]+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(10), chr(1) || chr(10) || chr(2)) FROM low),
parts AS (SELECT doc_id, unnest(string_split(t, chr(2))) AS p, unnest(range(1, len(string_split(t, chr(2))) + 1)) AS i, string_split(t, chr(2)) AS ps FROM cuts),
ends_at AS (SELECT doc_id, string_split(p, chr(1))[1] AS body,
              length(replace(array_to_string(ps[1:i - 1], ''), chr(1), '')) + length(string_split(p, chr(1))[1]) AS ends FROM parts),
hit AS (SELECT DISTINCT doc_id, ends, name FROM ends_at JOIN known ON sentence = {norm.format("body")}),
seq AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY ends, name) AS ids, string_agg(',' || name || ',', '' ORDER BY ends, name) AS s FROM hit GROUP BY doc_id),
lic AS (SELECT DISTINCT doc_id, licence FROM seq JOIN rules ON s LIKE pattern),
kept AS (SELECT * FROM lic l WHERE NOT EXISTS (SELECT 1 FROM stronger JOIN lic m ON m.licence = strong WHERE weak = l.licence AND m.doc_id = l.doc_id)),
listed AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM kept GROUP BY doc_id)
SELECT low.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM low LEFT JOIN seq USING (doc_id) LEFT JOIN listed USING (doc_id)"""


ORACLE_SQL = _sql()
