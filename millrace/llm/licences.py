"""Licence scans with DataFrame expressions only.

A text's words are compared with the words of licence templates (short notices, headers of source
files, heads of licence files) by the cosine of their sparse TF-IDF vectors. Each template has a key word;
wherever the text has that word, the window of the template's length that puts both keys in one place is
compared, so line breaks, comment marks and the prose around a notice don't matter. A window counts from the threshold on,
if it holds the words that the licence can't do without (its version or clause words) and none that
make it another licence; the best window names the file's own licence. Texts without any key word, which
four plain searches tell, are not taken apart.

A file whose licence makes up a good part of it also speaks for its directory, and files without a
licence take that of the nearest ancestor directory that has one, found by joining the distinct
directories' ancestors. Texts are read once and never shuffled.

Cases with a defined result: a null or empty text has no licence of its own; a null path has no
ancestors but keeps its row; repeated rows are each returned; of equally near licence files in one
directory the better score wins, then the later name; an empty table gives an empty result; further
columns pass through untouched, whatever their names, but columns of the results' names are refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse_names, write_table

THRESHOLD, FILE_SHARE, SALTS = 0.8, 0.05, 16


class Template(NamedTuple):
    """``must`` and ``ban``: words that the window, ``look`` words longer, holds all and none of."""

    licence: str
    key: str
    text: str
    must: tuple[str, ...] = ()
    ban: tuple[str, ...] = ()
    look: int = 0


_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_HEAD = "GNU {kind} Public License Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_TWO = ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_OTHER_GNU = ("lesser", "affero")


def _gnu(licence: str, what: str, kind: str, version: str, date: str, year: str) -> list[Template]:
    words = tuple(re.findall(r"[a-z0-9]+", version))
    own = tuple(kind.lower().split()[:-1])
    ban = tuple(w for w in _OTHER_GNU if w not in own) if kind != "Lesser General" else ("affero",)
    last = ("2", "3")["2" in words :][:1]
    short = f"licensed under the GNU {kind} Public License, version {version}."
    return [
        Template(licence, "licensed", f"This work is {short}", (*own, *words), (*ban, *last), 2),
        Template(licence, "licensed", short, (*own, *words), (*ban, *last), 2),
        Template(licence, "redistribute", _GNU.format(what=what, kind=kind, version=version), ("version", *own, *words), (*ban, *last), 4),
        Template(licence, "license", _HEAD.format(kind=kind, version=version, date=date, year=year), ("version", *own, *words), ban, 0),
    ]


def _cc(licence: str, letters: str, long: str, must: tuple[str, ...], ban: tuple[str, ...]) -> list[Template]:
    return [
        Template(licence, "licensed", f"Licensed under CC {letters} 4.0.", ("cc", *letters.lower().split("-"), "4"), tuple(w for w in ("nc", "sa", "nd") if w not in letters.lower()), 2),
        Template(licence, "licensed", f"This work is licensed under a Creative Commons {long} 4.0 International License.", ("creative", *must, "4"), ban, 2),
        Template(licence, "licensed", f"Licensed under a Creative Commons {long} 4.0 International License.", ("creative", *must, "4"), ban, 2),
    ]


TEMPLATES = [
    Template("Apache-2.0", "licensed", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    Template("Apache-2.0", "licensed", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache", "2")),
    Template("Apache-2.0", "license", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("apache", "2")),
    Template("MIT", "license", "Released under the MIT License.", ("mit",)),
    Template("MIT", "licensed", "Licensed under the MIT License.", ("mit",)),
    Template("MIT", "permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("free", "charge")),
    Template("MIT", "permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", ("free", "charge")),
    Template("ISC", "permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("fee",)),
    Template("BSD", "redistribution", _CLAUSES, (), ("retain",), 12),
    Template("BSD-2-Clause", "redistribution", _CLAUSES + _TWO, ("retain", "reproduce"), ("endorse", "advertising"), 45),
    Template("BSD-3-Clause", "redistribution", _CLAUSES + _TWO + _THIRD, ("retain", "reproduce", "endorse"), ("advertising",), 10),
    *_gnu("GPL-2.0", "program", "General", "2", "June 1991", "1989, 1991"),
    *_gnu("GPL-3.0", "program", "General", "3", "29 June 2007", "2007"),
    *_gnu("LGPL-2.1", "library", "Lesser General", "2.1", "February 1999", "1991, 1999"),
    *_gnu("LGPL-3.0", "library", "Lesser General", "3", "29 June 2007", "2007"),
    *_gnu("AGPL-3.0", "program", "Affero General", "3", "19 November 2007", "2007"),
    Template("MPL-2.0", "license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
    Template("MPL-2.0", "license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla", "2")),
    *_cc("CC-BY-4.0", "BY", "Attribution", ("attribution",), ("noncommercial", "sharealike", "noderivatives", "non", "share")),
    *_cc("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike", ("attribution", "sharealike"), ("noncommercial", "non")),
    *_cc("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial", ("attribution", "noncommercial"), ("sharealike", "noderivatives", "share")),
    Template("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain.", ("public", "domain")),
]


def split_words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower().replace("licenc", "licens")).split(" ") if w]


class Templates:
    """Normalised TF-IDF vectors of the templates, their idf and keys."""

    def __init__(self, templates: list[Template] | None = None, threshold: float = THRESHOLD) -> None:
        self.all, self.threshold = list(templates or TEMPLATES), threshold
        self.words = [split_words(t.text) for t in self.all]
        df = Counter(w for ws in self.words for w in set(ws))
        n = len(self.all)
        self.unseen = round(math.log(1 + n) + 1, 9)
        self.idf = {w: round(math.log((1 + n) / (1 + k)) + 1, 9) for w, k in sorted(df.items())}
        self.vectors = []
        for ws in self.words:
            v = {w: k * self.idf[w] for w, k in sorted(Counter(ws).items())}
            norm = math.sqrt(sum(x * x for x in v.values()))
            # The idf of the other side's word is put in, so that a window's dot product is a plain sum.
            self.vectors.append({w: round(x / norm * self.idf[w], 9) for w, x in v.items()})
        #: Key word → the templates that have it, and where.
        self.keys: dict[str, list[tuple[int, int]]] = {}
        for i, (t, ws) in enumerate(zip(self.all, self.words)):
            self.keys.setdefault(t.key, []).append((i, ws.index(t.key)))
        self.stems = sorted({"licens" if k.startswith("licens") else k for k in self.keys})


def _literal(x) -> str:
    """SQL for a constant; long ones are parsed at once, not built column by column."""
    if isinstance(x, dict):
        return "map(" + ",".join(f"{_literal(k)},{_literal(v)}" for k, v in x.items()) + ")"
    if isinstance(x, (list, tuple)):
        return "cast(array() AS array<string>)" if not x else f"array({','.join(map(_literal, x))})"
    return f"{x!r}D" if isinstance(x, float) else repr(x)


def best_licence(text: Column, templates: Templates) -> Column:
    """``struct<score, licence, share>`` of the best window, or null; ``share`` is its part of the text's words."""
    t = templates
    idf, vectors = F.expr(_literal(t.idf)), F.expr(_literal(t.vectors))
    names, lengths, looks = (F.expr(_literal(x)) for x in ([x.licence for x in t.all], [len(x) for x in t.words], [x.look for x in t.all]))
    musts, bans = F.expr(_literal([x.must for x in t.all])), F.expr(_literal([x.ban for x in t.all]))
    keys = F.expr("map(" + ",".join(f"{k!r},array({','.join(f'named_struct({chr(39)}t{chr(39)},{i},{chr(39)}o{chr(39)},{o})' for i, o in at)})" for k, at in t.keys.items()) + ")")
    lower = F.regexp_replace(F.lower(text), "licenc", "licens")
    held = reduce(lambda a, b: a | b, (F.lower(text).contains(s) for s in [*t.stems, "licenc"]))

    def norm(window: Column) -> Column:
        weight = lambda w: F.coalesce(idf[w], F.lit(t.unseen))
        state = lambda w, n, s: F.struct(w.alias("w"), n.alias("n"), s.alias("s"))
        closed = lambda a: a["s"] + F.when(a["n"] > 0, F.pow(a["n"] * weight(a["w"]), F.lit(2.0))).otherwise(0.0)
        step = lambda a, w: F.when(a["w"] == w, state(a["w"], a["n"] + 1, a["s"])).otherwise(state(w, F.lit(1), closed(a)))
        return F.sqrt(F.aggregate(F.array_sort(window), state(F.lit(""), F.lit(0), F.lit(0.0)), step, closed))

    def judge(words: Column, c: Column) -> Column:
        window, seen = F.slice(words, c["s"] + 1, F.get(lengths, c["t"])), F.slice(words, c["s"] + 1, F.get(lengths, c["t"]) + F.get(looks, c["t"]))
        fits = F.forall(F.get(musts, c["t"]), lambda m: F.array_contains(seen, m)) & ~F.exists(F.get(bans, c["t"]), lambda m: F.array_contains(seen, m))
        dot = F.aggregate(window, F.lit(0.0), lambda a, w: a + F.coalesce(F.get(vectors, c["t"])[w], F.lit(0.0)))
        return F.when(fits, F.struct(F.round(dot / norm(window), 6).alias("score"), F.get(names, c["t"]).alias("licence"), F.round(F.size(window) / F.size(words), 6).alias("share")))

    def judged(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), keys[w].alias("k"))), lambda x: x["k"].isNotNull())
        found = F.flatten(F.transform(places, lambda p: F.transform(p["k"], lambda k: F.struct(k["t"].alias("t"), F.greatest(p["i"] - k["o"], F.lit(0)).alias("s")))))
        return F.array_max(F.filter(F.transform(F.array_distinct(found), lambda c: judge(words, c)), lambda s: s["score"] >= t.threshold))

    words = F.filter(F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.when(held, F.transform(F.array(words), judged)[0])


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE, templates: list[Template] | None = None, keep_text: bool = False) -> DataFrame:
    """The rows with all their columns (the text only if asked) and ``licence, licence_score, found_in,
    inherited``: found_in is the path, or the directory that a licence was inherited from."""
    t = Templates(templates, threshold)
    kept = [c for c in files.columns if keep_text or c != text]
    refuse_names(files.select(*kept), "licence", "licence_score", "found_in", "inherited")
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("r")  # so that no other name can clash with theirs
    own, _ = write_table(files.select(row, best_licence(F.col(text), t).alias("own"), F.col(path).alias("path"), F.regexp_extract(F.col(path), "^(.*)/", 1).alias("dir")), "licences")
    speaking = own.where((F.col("own.share") >= file_share) & F.col("path").isNotNull())
    declared = speaking.groupBy(F.col("dir").alias("ancestor")).agg(F.max(F.struct(F.col("own.score").alias("score"), F.col("own.licence").alias("licence"))).alias("said"))
    dirs = own.where(F.col("path").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("ancestor"))
    nearest = ancestors.join(declared, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "said")).alias("from"))
    # A directory may hold a third of all files: its one row is joined under each of a few salts.
    salted = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    joined = salted.join(nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["dir", "salt"], "left")
    mine = F.col("own").isNotNull()
    taken = ~mine & F.col("from").isNotNull() & F.col("path").isNotNull()
    return joined.select(
        "r.*",
        F.when(mine, F.col("own.licence")).when(taken, F.col("from.said.licence")).alias("licence"),
        F.when(mine, F.col("own.score")).when(taken, F.col("from.said.score")).alias("licence_score"),
        F.when(mine, F.col("path")).when(taken, F.col("from.ancestor")).alias("found_in"),
        taken.alias("inherited"),
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """Where the query takes a document to lie: its source, then one to three levels by a hash of its id."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    levels = [F.substring(h, 1, 1), F.substring(h, 2, 1), F.substring(h, 3, 1)]
    depth = F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4
    parts = [F.coalesce(source, F.lit("unknown")), *(F.when(depth > i, x) for i, x in enumerate(levels)), F.coalesce(doc_id.cast("string"), F.lit("null"))]
    return F.concat_ws("/", *parts)


def sql(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    t = Templates()
    vectors = ", ".join(f"({k}, '{w}', {x!r}::DOUBLE)" for k, v in enumerate(t.vectors) for w, x in v.items())
    names = ", ".join(f"({k}, '{x.licence}', {len(ws)}, {x.look}, {list(x.must)}::VARCHAR[], {list(x.ban)}::VARCHAR[])" for k, (x, ws) in enumerate(zip(t.all, t.words)))
    keys = ", ".join(f"('{w}', {k}, {o})" for w, at in t.keys.items() for k, o in at)
    idf = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in t.idf.items())
    holds = " OR ".join(f"contains(lower(text), '{s}')" for s in [*t.stems, "licenc"])
    return f"""WITH tv AS (SELECT * FROM (VALUES {vectors}) v(k, w, x)), idf AS (SELECT * FROM (VALUES {idf}) v(w, idf)),
tn AS (SELECT * FROM (VALUES {names}) v(k, licence, size, look, must, ban)), tk AS (SELECT * FROM (VALUES {keys}) v(w, k, o)),
f AS (SELECT row_number() OVER () AS rid, doc_id, text, md5(coalesce(doc_id::VARCHAR, 'null')) AS h, coalesce(source, 'unknown') AS src FROM {table}),
p AS (SELECT *, ('0x' || substr(h, 4, 1))::INTEGER % 4 AS depth FROM f),
q AS (SELECT rid, doc_id, text, src || CASE WHEN depth > 0 THEN '/' || substr(h, 1, 1) ELSE '' END || CASE WHEN depth > 1 THEN '/' || substr(h, 2, 1) ELSE '' END || CASE WHEN depth > 2 THEN '/' || substr(h, 3, 1) ELSE '' END AS dir FROM p),
g AS (SELECT rid, list_filter(string_split(regexp_replace(replace(lower(text), 'licenc', 'licens'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM q WHERE {holds}),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM g),
c AS (SELECT DISTINCT rid, k, greatest(i - 1 - o, 0) AS s FROM u JOIN tk USING (w)),
v AS (SELECT row_number() OVER () AS cid, c.rid, c.k, licence, size, ws[s + 1 : s + size] AS win, ws[s + 1 : s + size + look] AS seen, must, ban, len(ws) AS n FROM c JOIN tn USING (k) JOIN g ON g.rid = c.rid),
ok AS (SELECT cid, rid, k, licence, win, n FROM v WHERE list_has_all(seen, must) AND NOT list_has_any(seen, ban)),
tf AS (SELECT cid, k, w, count(*) AS n FROM (SELECT cid, k, unnest(win) AS w FROM ok) GROUP BY 1, 2, 3),
sc AS (SELECT cid, round(sum(coalesce(n * x, 0)) / sqrt(sum(pow(n * coalesce(idf, {t.unseen!r}), 2))), 6) AS score FROM tf LEFT JOIN tv ON tf.k = tv.k AND tf.w = tv.w LEFT JOIN idf ON tf.w = idf.w GROUP BY 1),
best AS (SELECT rid, max({{'a': score, 'b': licence, 'c': round(len(win)::DOUBLE / n, 6)}}) AS s FROM ok JOIN sc USING (cid) WHERE score >= {t.threshold} GROUP BY 1),
o AS (SELECT q.rid, doc_id, dir, dir || '/' || coalesce(doc_id::VARCHAR, 'null') AS path, s FROM q LEFT JOIN best ON q.rid = best.rid),
d AS (SELECT dir AS ancestor, max({{'a': s.a, 'b': s.b}}) AS said FROM o WHERE s.c >= {FILE_SHARE} GROUP BY 1),
near AS (SELECT o.rid, max_by(d.said, length(ancestor)) AS said, max_by(ancestor, length(ancestor)) AS ancestor FROM o JOIN d ON o.dir = d.ancestor OR starts_with(o.dir, d.ancestor || '/') GROUP BY 1)
SELECT doc_id, path, CASE WHEN s IS NOT NULL THEN s.b ELSE said.b END AS licence, CASE WHEN s IS NOT NULL THEN s.a ELSE said.a END AS licence_score,
CASE WHEN s IS NOT NULL THEN path ELSE ancestor END AS found_in, s IS NULL AND ancestor IS NOT NULL AS inherited FROM o LEFT JOIN near ON o.rid = near.rid"""
