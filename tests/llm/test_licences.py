import math
import textwrap
from collections import Counter

import duckdb
import pandas as pd
import pytest

from millrace.llm import licences as L

SCHEMA = "path string, text string, licence string"


def own_licence(text, t, threshold):
    """The best window by the definition, every key of every template in turn."""
    weight = lambda w: t.idf.get(w, t.unseen)
    size = lambda v: math.sqrt(sum((n * weight(w)) ** 2 for w, n in v.items()))
    words, found = L.split_words(text or ""), []
    for x in t.all:
        own = L.split_words(x.text)
        b = Counter(own)
        for at in (i for i, w in enumerate(words) if w == x.key):
            begin = max(0, at - own.index(x.key))
            window, seen = words[begin : begin + len(own)], words[begin : begin + len(own) + x.look]
            if set(x.must) <= set(seen) and not set(x.ban) & set(seen):
                a = Counter(window)
                cos = sum(n * b[w] * weight(w) ** 2 for w, n in a.items()) / size(a) / size(b)
                if round(cos, 6) >= threshold:
                    found.append((round(cos, 6), x.licence, round(len(window) / len(words), 6)))
    return max(found, default=None)


def brute(rows, threshold=L.THRESHOLD, share=L.FILE_SHARE):
    t = L.Templates(threshold=threshold)
    own = [own_licence(text, t, threshold) for path, text, *_ in rows]
    said = {}
    for (path, *_), f in zip(rows, own):
        if f and path is not None and f[2] >= share:
            d = path.rpartition("/")[0]
            said[d] = max(said.get(d, (0, "")), f[:2])
    out = []
    for (path, *_), f in zip(rows, own):
        if f:
            out.append((path, f[1], f[0], path, False))
            continue
        d = path.rpartition("/")[0] if path is not None else None
        while d is not None and d not in said:
            d = d.rpartition("/")[0] if "/" in d else None
        out.append((path, said[d][1], said[d][0], d, True) if d is not None else (path, None, None, None, False))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    mit, apache, gpl = "Released under the MIT License.", "# Licensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License version 3"
    prose = "some words of prose that go on and on\n" * 20
    rows = [
        ("a/LICENSE", mit), ("a/x.py", prose), ("a/b/c/y.py", prose), ("a/b/LICENSE", apache), ("a/b/c/z.py", gpl + "\n" + prose), ("d/one", prose + apache), ("d/two", prose), ("top", None), ("a/b/e", ""), (None, mit), (None, prose),
        ("f/L1", mit), ("f/L2", apache), ("f/g", "licence of nothing; licensed apache mit"), ("f/g", "licence of nothing; licensed apache mit"), ("ab/x", prose), ("h/long", "the license " * 900), ("m/LICENSE", MIT), ("m/a.c", "/* " + BSD.replace(" source", "\n * source") + THIRD + " */ code"), ("h/i", gpl.upper() + "!!"), ("h/j/k", "x"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).drop("licence").withColumnRenamed("text", "body").selectExpr("path", "body", "1 AS n")
    got = L.scan(df, text="body")
    assert got.columns[:2] == ["path", "n"]
    assert sorted(map(tuple, got.select("path", "licence", "licence_score", "found_in", "inherited").collect()), key=str) == brute(rows)
    assert L.scan(df.limit(0), text="body").collect() == []
    clashing = df.selectExpr("path", "body", "1 AS __own", "2 AS own", "3 AS dir", "4 AS said", "5 AS r", "6 AS salt")
    same = L.scan(clashing, text="body", keep_text=True)
    assert same.columns[:8] == clashing.columns and same.count() == len(rows) and same.agg({"dir": "min"}).first()[0] == 3
    with pytest.raises(ValueError):
        L.scan(df.selectExpr("path", "body", "1 AS Licence"), text="body")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."""


def test_real_notices():
    """Wrapped as they are in the wild, with comment marks and other text around them."""
    t = L.Templates()
    cases = {
        MIT: "MIT", "Copyright (c) 2020 Some One\n\n" + MIT: "MIT", BSD: "BSD-2-Clause", BSD + THIRD: "BSD-3-Clause", "Use of this source code is governed by a license.": None,
        GNU.format("program", ":", "General", ",", 3): "GPL-3.0", GNU.format("program", ";", "General", ";", 2): "GPL-2.0", GNU.format("library", ";", "Lesser General", ";", "2.1"): "LGPL-2.1",
        GNU.format("library", ":", "Lesser General", ",", 3): "LGPL-3.0", GNU.format("program", ":", "Affero General", ",", 3): "AGPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under the GNU Lesser General Public License version 3": "LGPL-3.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at": "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.": "Apache-2.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-NC-ND 4.0": None, "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at": "MPL-2.0", "the licence of the driver was taken away, and permission refused": None,
    }
    for text, licence in cases.items():
        for width in (40, 70, 78, 10_000):
            for mark in ("", " * ", "# "):
                wrapped = "\n".join(mark + line for line in textwrap.wrap(text, width))
                for whole in (wrapped, "Words before it.\n" + wrapped + "\nand others after it, in plenty.", "some prose " * 300 + wrapped):
                    found = own_licence(whole, t, L.THRESHOLD)
                    assert (found and found[1]) == licence, (text, width, found)


def prose(n):
    return " word" * n


def test_query_matches_sql(spark):
    texts = [GNU.format("program", ";", "General", ";", 2) + prose(900), MIT, "Licensed under CC BY-NC 4.0.", "prose here\nRelease under MIT License", "x " * 90, None, "", "a\nThis work is licensed under the GNU General Public License, version 3.\n" + "b " * 900]
    rows = [(i if i else None, texts[i * 7 % 8], f"src{i % 3}" if i % 11 else None) for i in range(300)]
    from millrace.llm.queries import licence_rows

    got = licence_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(L.sql()).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len({r.licence for r in got}) > 2
