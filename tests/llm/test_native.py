import json
import random

import duckdb

from cinderglass.llm import chat_format, license_scan
from cinderglass.llm.chat_format import link_tool_calls, op1_chat_format
from cinderglass.llm.license_scan import op4_license_scan

D = "/root/testdata/sf0.01"


def compare(spark, query, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    got = query(spark, D)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, res.fetchall()))
    assert not any(w in got._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def test_license_scan_equals_sql(spark):
    compare(spark, op4_license_scan, license_scan.ORACLE, ["documents"])


def test_license_rules(spark):
    wrapped = 'Copyright 2020 X\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except\nin compliance with the License.\nMore.'
    bsd = ". ".join(license_scan.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    rows = [(1, wrapped, ""), (2, None, ""), (3, "", ""), (4, bsd, ""), (5, "no | end\nAll rights reserved\nx", ""), (6, license_scan.SENTENCES["mit-notice"], "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, licenses string")
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(df).collect()}
    assert got == {1: ["Apache-2.0"], 2: [], 3: [], 4: ["BSD-2-Clause"], 5: ["Proprietary"], 6: []}
    assert license_scan.license_scan(df.limit(0)).count() == 0


NOTICES = {
    "GPL-3.0-or-later": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
    "EUPL-1.2": 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");\nYou may not use this work except in compliance with the Licence.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
CLAUSE3 = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n'


def test_notices_as_they_stand(spark):
    rows = [(k, "Some code.\n\n" + text + "\nint x;") for k, text in enumerate(NOTICES.values())] + [(100, BSD2), (101, BSD2 + CLAUSE3), (102, BSD2 + "int x;\n" + BSD2 + CLAUSE3), (103, BSD2 + CLAUSE3 + MIT + BSD2), (104, CLAUSE3)]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [[n] for n in NOTICES]
    assert (got[100], got[101], got[104]) == (["BSD-2-Clause"], ["BSD-3-Clause"], [])
    assert got[102] == got[103][:2] == ["BSD-2-Clause", "BSD-3-Clause"] and got[103] == ["BSD-2-Clause", "BSD-3-Clause", "MIT"]
    assert all(any(a in t for a in license_scan.ANCHORS) for t in license_scan.SENTENCES.values())


def test_chat_equals_sql(spark):
    compare(spark, op1_chat_format, chat_format.ORACLE, ["conversations"])


def test_links_levels_and_validation(spark):
    schemas = {"f": {"properties": {"a": "integer", "b": "array"}, "required": ["a"]}}
    calls = spark.createDataFrame(
        [(1, 1, "x", "f", '{"b": [2, {"z":1,"y":2}], "a": 1}', []), (1, 2, "y", "f", '{"a": "1", "q": 0}', ["x", "gone"]), (1, 3, "z", "g", "{}", ["y", "x"]), (1, 4, "p", "f", "[1]", ["q"]), (1, 5, "q", "f", "bad", ["p"]), (1, 6, None, "f", None, None)],
        "conv_id int, turn int, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("x", 2, "r2"), ("x", 1, "r1"), ("other", 3, "r"), ("y", 1, None)], "call_id string, result_turn int, content string")
    rows = {r.call_id: r for r in link_tool_calls(calls, results, schemas).collect()}
    assert [rows[k].level for k in "xyzpq"] == [0, 1, 2, None, None]
    assert rows["x"].errors == "several results" and json.loads(rows["x"].record)["result"] == "r1"
    assert '"arguments":{"a":1,"b":[2,{"y":2,"z":1}]}' in rows["x"].record
    assert rows["y"].errors == "a is not integer; unexpected q"
    assert "unknown tool" in rows["z"].errors and "dependency cycle" in rows["p"].errors and "not an object" in rows["q"].errors
    assert rows["other"].errors == "result without call" and rows["other"].conv_id is None
    assert link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def brute_levels(needs):
    levels, left = {}, dict(needs)
    while ready := [k for k, n in left.items() if all(x in levels for x in n if x in needs)]:
        for k in ready:
            levels[k] = max((levels[x] + 1 for x in left.pop(k) if x in needs), default=0)
    return levels


def test_levels_of_chains_merges_and_cycles(spark):
    rng = random.Random(5)
    needs = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(40)}
    needs |= {f"m{i}": {f"c{rng.randrange(40)}", f"m{i - 1}"} if i % 3 else {f"m{i - 1}"} for i in range(12)}
    needs |= {f"r{i}": {f"r{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))} for i in range(40)}
    needs |= {"loop1": {"loop3"}, "loop2": {"loop1"}, "loop3": {"loop2"}, "self": {"self"}, "after": {"self"}, "mixed": {"c3", "after"}, "fan": {"c0"}}
    rows = [(k, sorted(n)) for k, n in needs.items()] + [("c9", ["c8", "c8", None]), (None, ["c1"]), ("c1", None)]
    calls = spark.createDataFrame(rows, "call_id string, depends_on array<string>")
    got = [(r.call_id, r.level) for r in chat_format._levels(calls).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute_levels(needs)


def test_chat_with_extra_columns_long_arguments_and_hot_ids(spark):
    schemas = {"f": {"properties": {"a": "string"}, "required": ["a"]}}
    long = "x" * 2_000_000
    rows = [(1, 1, "big", "f", json.dumps({"a": long}), [], "l", 3)] + [(1, k, "hot", "f", '{"a": "1"}', ["big"], "l", 3) for k in range(500)] + [(1, k, None, "f", '{"a": "1"}', None, None, None) for k in range(500)]
    calls = spark.createDataFrame(rows, "conv_id int, turn int, call_id string, name string, arguments string, depends_on array<string>, level string, n_results int")
    results = spark.createDataFrame([("big", 2, long, "e"), (None, 1, "nobody's", "e"), ("hot", 9, "r", "e")], "call_id string, result_turn int, content string, errors string")
    out = link_tool_calls(calls, results, schemas).cache()
    big = out.where("call_id = 'big'").first()
    assert big.valid and big.level == 0 and json.loads(big.record) == {"arguments": {"a": long}, "call_id": "big", "errors": [], "name": "f", "result": long}
    counts = {(r.call_id, r.level, r.errors): r["count"] for r in out.groupBy("call_id", "level", "errors").count().collect()}
    assert counts == {("big", 0, ""): 1, ("hot", 1, ""): 500, (None, None, "call without result"): 500, (None, None, "result without call"): 1}
