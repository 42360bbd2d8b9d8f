import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchside.llm import fingerprints, licenses, permutation_index, private_data, quality
from pitchside.llm.common import shingle_hashes
from pitchside.llm.near import components, jaccard
from tests.llm.test_dedup import row_truth

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def base_truth(t):
    bare = lambda s: re.sub("[ -]", "", s)
    out = {"email": [m.span() for m in EMAIL.finditer(t)]}
    out["ip"] = [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(t) if 16 <= len(bare(m[0])) <= 19 and luhn(bare(m[0]))]
    out["phone"] = [m.span() for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


SEEDS = ["a@b.co", "4111 1111 1111 1111", "1.2.3.4", "+1 (234) 555-0199", "@", ".", "+", " ", "-", "12", "300.1.1.1", "x", "é", "a.b@c", "@d.e", "\n", "0", "4111111111111111"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SEEDS), max_size=12).map("".join))
def test_base_spans_are_those_of_the_patterns(t):
    found = private_data.find_spans(t)
    assert {k: found[k] for k in private_data.BASE} == base_truth(t)


def test_added_spans():
    t = 'see https://a.example/x, IBAN: DE89 3704 0044 0532 0130 00 token = "abcdef123456" account no. 12345678 AccountX 9'
    f = private_data.find_spans(t)
    assert [t[a:b] for a, b in f["url"]] == ["https://a.example/x"]
    assert [t[a:b] for a, b in f["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert [t[a:b] for a, b in f["secret"]] == ["abcdef123456"]
    assert private_data.redacted("mail a@b.co now") == "mail [EMAIL] now"


def test_long_runs_take_linear_time():
    private_data.find_spans("1" * 300_000 + " " + "a" * 300_000 + "@" + "1.2" * 50_000 + "+1((((" * 20_000)


def test_private_rows(docs, no_docs, rows):
    got = private_data.detect(docs).collect()
    assert len(got) == len(rows)
    none = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == none for r in got if not r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"])
    assert all(r["n_spans"] == sum(r[f"n_{k}"] for k in private_data.KINDS) == (r["spans"].count(",") + 1 if r["spans"] else 0) for r in got)
    assert private_data.detect(no_docs).count() == 0
    assert private_data.redact(docs).count() == len(rows)


def plain_signature(text):
    """The least value of each hash function over the shingles, with Python's own whole numbers."""
    grams, _ = shingle_hashes([text])
    if not len(grams):
        return [0xFFFFFFFF] * fingerprints.PERMS
    ab = [(int(a), int(b)) for a, b in zip(fingerprints._A, fingerprints._B, strict=True)][: fingerprints.PERMS]
    return [min((int(g) * a + b) % 2**64 >> 32 for g in grams) for a, b in ab]


def test_fingerprints(spark, docs, no_docs, rows):
    before = fingerprints.RANGE_BYTES
    fingerprints.RANGE_BYTES = 4_000  # several ranges
    try:
        got = fingerprints.fingerprint(docs).collect()
    finally:
        fingerprints.RANGE_BYTES = before
    key = lambda r: tuple(str(x) for x in r)
    order = sorted(((i if i is not None else -(2**63), t or "") for i, t, *_ in rows), key=lambda r: (-r[0], r[1]))
    found, least = row_truth(rows)
    classes = {t or "": least[c] for (c, _), (_, t, *_) in zip(found, rows, strict=True)}
    hexed = lambda v: "".join(f"{x:08x}" for x in v)
    share = lambda u, v: sum(x == y for x, y in zip(u, v, strict=True)) / len(u)
    back = lambda i: None if i == -(2**63) else i
    want = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + following[:m]
        own, other, after = map(plain_signature, (t, e, following))
        want.append((back(i), len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(own), hexed(other), share(own, other), share(own, after), back(classes[t])))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert fingerprints.fingerprint(no_docs).count() == 0


def test_signatures_estimate_jaccard():
    a = " ".join(f"a{i}" for i in range(400))
    b = " ".join(f"a{i}" for i in range(300)) + " " + " ".join(f"b{i}" for i in range(100))
    sig = fingerprints.signatures([a, b, a, ""], 512)
    assert abs((sig[0] == sig[1]).mean() - 296 / 496) < 0.08
    assert (sig[0] == sig[2]).all()


def test_similar_pairs_are_verified(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pairs = {(r["a"], r["b"]) for r in fingerprints.similar_pairs(rows).collect()}
    assert (0, 20) in pairs and (0, 21) in pairs
    assert jaccard(b"", b"") == 1.0


def toy(n=300, seed=4):
    rng = np.random.default_rng(seed)
    good = [" ".join(rng.choice(["the", "river", "was", "wide", "and", "calm"], 40)) + "." for _ in range(n)]
    bad = [" | ".join(f"{w}###" for w in rng.choice(["BUY", "NOW", "!!", "$$"], 30)) for _ in range(n)]
    return good, bad


def test_quality_learns_and_holds_out(spark, docs, no_docs):
    good, bad = toy()
    rows = [(i, t) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, labels)
    got = quality.score(table, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got)
    assert quality.score(docs, model).count() == docs.count()
    kept = quality.filter_documents(docs, model)
    assert kept.columns == docs.columns
    assert quality.score(no_docs, model).count() == 0


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.filter_documents(docs, model).count() == docs.count()


def test_licenses(spark, docs, no_docs, rows):
    s = licenses.SENTENCES
    full = "Foo.\n" + s["mit-grant"].capitalize() + ".\n" + s["mit-notice"] + "!\n" + s["as-is"] + "."
    cases = {
        1: (full, "MIT"),
        2: ("// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"),
        3: ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "Apache-2.0"),
        4: ("x\n".join(s[k] + "\n" for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ""),
        5: ("\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), "BSD-3-Clause"),
        6: ("\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")) + "\nReleased under the MIT License.", "BSD-2-Clause,MIT"),
        7: ("This is no licence at all.", ""),
        8: (None, ""),
        9: ("Licensed under GPLv3 or later", "GPL-3.0-or-later"),
    }
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    del cases[4]  # sentences run into other text
    assert {i: got[i] for i in cases} == {i: want for i, (_, want) in cases.items()}
    assert licenses.scan(docs).count() == len(rows)
    assert licenses.scan(no_docs).count() == 0


def brute_neighbours(vectors, queries, k=5):
    out = {}
    for q, v in vectors:
        if q in queries:
            s = sorted((-permutation_index.cosine(v, w), i) for i, w in vectors if i != q)
            out[q] = [(i, -c) for c, i in s[:k]]
    return out


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    x[40:60] = x[0]  # copies, more than are asked for
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0], 1), (None, [1.0] * 16, 1), (2050, [1e300] * 16, 2)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in permutation_index.search(table, lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, np.array(v)) for i, v, _ in rows] + [(2050, np.full(16, 1e300))]
    want = brute_neighbours(usable, {i for i, _ in usable if i % 50 == 0})
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit += len({m[1] for m in mine} & {i for i, _ in w})
    assert hit / (5 * len(want)) >= 0.9
    assert [m[1] for m in sorted(got[0])] == [40, 41, 42, 43, 44]


def test_recall_of_vectors_without_clusters():
    """Random directions in 64 dimensions, the hardest case: 15 % of the vectors are compared."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    pivots = permutation_index.unit(x[rng.choice(6000, permutation_index.PIVOTS, replace=False)])
    shard = permutation_index.Shard(x, pivots)
    hit = 0
    for i in range(0, 6000, 50):
        near, _ = shard.nearest(shard.unit[i], permutation_index.prefixes(shard.unit[i : i + 1], pivots)[0], 5, permutation_index.FRACTION)
        assert len(near) == 900
        hit += len(set(near.tolist()) & set(np.argsort(-(shard.unit @ shard.unit[i]))[1:6].tolist()))
    assert hit / (5 * 120) >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert permutation_index.search(none, lambda i: i % 50 == 0).count() == 0


def test_licenses_as_files_hold_them(spark):
    """Hyphens in names, line-wrapped texts behind comment marks, the usual Apache header."""
    s = licenses.SENTENCES
    wrapped = lambda x, mark="": "\n".join(mark + " ".join(x.split()[i : i + 11]) for i in range(0, len(x.split()), 11))
    cases = {
        1: ("Released under CC-BY-4.0.", "CC-BY-4.0"),
        2: ("Available under CC-BY-SA 4.0.", "CC-BY-SA-4.0"),
        3: ("MIT\n\n" + ".\n\n".join(wrapped(s[k], " * ") for k in ("mit-grant", "mit-notice", "as-is")), "MIT"),
        4: ("Copyright X\n" + ":\n1. ".join(wrapped(s[k]) for k in ("bsd-grant", "bsd-source", "bsd-binary")), "BSD-2-Clause"),
        5: ('# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except\n# in compliance with the License.', "Apache-2.0"),
        6: ("// This program is free software; you can redistribute it and/or modify\n//" + wrapped(s["gpl2-free"].split(" or modify ")[1], "// "), "GPL-2.0-or-later"),
        7: ("This work is\nlicensed under the MIT License", "MIT"),
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {i: want for i, (_, want) in cases.items()}
    assert got[5]["sentence_ids"] == "name:Apache-2.0,apache-use" and got[7]["n_known"] == 1


def test_links_that_the_least_of_a_bucket_lacks(spark, tmp_path):
    """A chain: each text is close to the next only, all share buckets."""
    chain = [(i, " ".join(f"t{j}" for j in range(3 * i, 3 * i + 60))) for i in range(25)]
    path = tmp_path.as_uri() + "/chain"
    spark.createDataFrame(chain, "doc_id long, text string").write.parquet(path)
    found = fingerprints.similar_pairs(spark.read.parquet(path)).collect()
    assert {r["c"] for r in components(spark.createDataFrame([(r["a"], r["b"]) for r in found], "a long, b long")).collect()} == {0}
    assert len({i for r in found for i in (r["a"], r["b"])}) == 25

#: Notices and texts as files hold them, and what they are.
SHIPPED = {
    "MIT": 'MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "BSD-3-Clause": '/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n *\n * 1. Redistributions of source code must retain the above copyright notice, this\n *    list of conditions and the following disclaimer.\n *\n * 2. Redistributions in binary form must reproduce the above copyright notice,\n *    this list of conditions and the following disclaimer in the documentation\n *    and/or other materials provided with the distribution.\n *\n * 3. Neither the name of Example Works nor the names of its\n *    contributors may be used to endorse or promote products derived from\n *    this software without specific prior written permission.\n */\nint main;',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n  * Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n  * Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.",
    "ISC": 'Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND EXAMPLE DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.',
    "Apache-2.0": '# Copyright 2020 Someone\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nimport x',
    "GPL-3.0-or-later": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n//\n// This program is distributed in the hope that it will be useful,",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "My notes\nThis work is licensed under a Creative Commons Attribution 4.0 International License\nand more",
    "MIT,Apache-2.0": "Licensed under the MIT License. Released under the Apache License, Version 2.0.",
    "": "The license plate of the software team's car has no permission to park.",
}


def test_licences_as_shipped(spark, tmp_path):
    """Wrapped texts behind comment marks; the SQL finds the same; what a rule takes leaves a gap."""
    import duckdb

    s = licenses.SENTENCES
    rows = [(i, t) for i, t in enumerate(SHIPPED.values())]
    gap = f"{s['bsd-grant']}. Licensed under the MIT License. {s['bsd-source']}. {s['bsd-binary']}."
    rows += [(100, gap), (101, None), (102, ""), (100, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path.as_uri()}/documents.parquet")
    got = licenses.op6(spark, tmp_path.as_uri()).collect()
    assert {r["doc_id"]: r["licenses"] for r in got if r["doc_id"] < 100} == {i: want for i, want in enumerate(SHIPPED)}
    assert sorted(r["licenses"] for r in got if r["doc_id"] >= 100) == ["", "", "MIT", "MIT"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.sql(licenses.SQL["op6_license_rules"]).fetchall())


def test_every_known_sentence_has_a_cue_and_a_start():
    import re

    for text in [*licenses.known_sentences(), *[f"licensed under {n}" for n in licenses.known_names()]]:
        assert re.search(licenses.CUE, text) and re.search(licenses.starts(), text), text


LICENSE_CASES = {
    "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": "GPL-2.0",
    "SPDX-License-Identifier: (MIT AND BSD-3-Clause)": "MIT,BSD-3-Clause",
    "License: MIT": "MIT",
    "Released under the MIT license by Acme Corp.": "MIT",
    "licensed under the MIT License (see LICENSE for details)": "MIT",
    "dual-licensed under MIT and Apache-2.0": "MIT,Apache-2.0",
    "The text is available under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY 4.0": "CC-BY-4.0",
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)": "BSL-1.0",
    "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0\nwhich is available at https://x.example": "EPL-2.0",
    "This software is provided 'as-is', without any express or implied\nwarranty.  Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": "Zlib",
    "licensed under the GPLv3 or any later version": "GPL-3.0-or-later",
    "The license fee is due. A license to drive": "",
    "mit license\n" + "# " * 20_000: "MIT",
    "mit license\n" + "-- ;#; " * 20_000 + "\n" + "ab\n" * 5_000: "MIT",
    "# Permission\n# " + "\n# ".join("is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:".split(" ")): "MIT",
}


def test_license_notices_marks_and_many_lines(spark, tmp_path):
    """Notices of several names and with clauses; long runs of comment marks end no task; a word a line is no cap; SQL agrees."""
    import duckdb

    rows = [(i, t, None, None, None) for i, t in enumerate(LICENSE_CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path.as_uri()}/documents.parquet")
    got = licenses.op6(spark, tmp_path.as_uri()).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == dict(enumerate(LICENSE_CASES.values()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.sql(licenses.SQL["op6_license_rules"]).fetchall())
