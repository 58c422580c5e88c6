"""Licence scan by sentence rules, in column expressions only.

Texts are cut into sentences, sentences are normalised and looked up in a table of
known licence sentences; a text's sequence of identifiers is then held against ordered
rules.  A rule applies where its identifiers follow one another in the sequence
(sentences that are not known do not count between them).  The longest rule wins: one
that is part of a longer rule applies only outside the places of that one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.functions.spread import spread
from cinderglass.llm.shared import table

#: Known licence sentences, fixed values: identifier and normalised text, as sentences end here.
SENTENCES: dict[str, str] = {
    "mit-short": "released under the mit license",
    "mit-short-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-copy-basis": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "free-program": "this program is free software",
    "free-library": "this library is free software",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "version-2": "version 2 of the license",
    "either-2": "either version 2 of the license or at your option any later version",
    "either-2-1": "either version 2 1 of the license or at your option any later version",
    "either-3": "either version 3 of the license or at your option any later version",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl2-form": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "eupl-grant": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence",
    "eupl-use": "you may not use this work except in compliance with the licence",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl2": "spdx license identifier gpl 2 0 only",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-lgpl21": "spdx license identifier lgpl 2 1 only",
    "spdx-agpl3": "spdx license identifier agpl 3 0 only",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-mpl2": "spdx license identifier mpl 2 0",
}

#: Licence rules, fixed values: licence and the ordered sentence identifiers of each rule.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-grant", "apache-use"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl3-only"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "either-3"]),
    ("GPL-2.0", ["gpl2-only"]),
    ("GPL-2.0", ["gpl-terms", "version-2"]),
    ("GPL-2.0", ["spdx-gpl2"]),
    ("GPL-2.0-or-later", ["gpl-terms", "either-2"]),
    ("LGPL-2.1", ["spdx-lgpl21"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "either-2-1"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "either-3"]),
    ("AGPL-3.0", ["spdx-agpl3"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["spdx-bsd2"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl-form", "mpl2-copy-http"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("EPL-2.0", ["epl2-form"]),
    ("EUPL-1.2", ["eupl-grant", "eupl-use"]),
    ("Zlib", ["zlib-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-long"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["all-rights"]),
]

#: Every known sentence holds one of these; texts without any are not cut up.
ANCHORS = ["licen", "eupl", "mpl was", "copyright", "permitted", "all rights reserved", "public domain", "permission", "free software", "without warranty", "cc by", "redistribution"]

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = r"[.;:!?]+[ \t\n\r\f]+"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOW), "[^a-z0-9]+", " "))


def _key(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _longer(ids: list[str], rules: list[tuple[str, list[str]]]) -> list[str]:
    """Longer rules that hold a rule, longest first."""
    return sorted({_key(r) for _, r in rules if len(r) > len(ids) and _key(ids) in _key(r)}, key=lambda k: (-k.count("<"), k))


def license_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Add ``sentence_ids`` and ``licenses`` to ``docs(text)``.

    A sentence ends at one of ``. ; : ! ?`` before white space.  A sentence that is not
    known as a whole is looked up line by line.  ``sentence_ids`` are in text order with
    repeats, ``licenses`` sorted and distinct; null, empty and clean texts have none.
    Input columns of these names are replaced.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = F.create_map(*(F.lit(x) for name, text in sentences.items() for x in (text, name)))
    anchors = ANCHORS if all(any(a in t for a in ANCHORS) for t in sentences.values()) else [""]
    spaced = [re.escape(a).replace(r"\ ", "[^a-z0-9]+") for a in anchors]
    may = F.coalesce(F.col("text").rlike("(?i)" + "|".join(spaced)), F.lit(False))
    look = lambda u: F.try_element_at(known, _normal(u))
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), look), lambda x: x.isNotNull())
    units = F.flatten(F.transform(F.split("text", _END), lambda s: F.when(look(s).isNotNull(), F.array(look(s))).otherwise(lines(s))))
    none = F.array().cast("array<string>")
    out = spread(docs.drop("sentence_ids", "licenses")).withColumn("sentence_ids", F.when(may, units).otherwise(none))
    chain = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")

    def won(name: str, ids: list[str]) -> Column:
        left = chain
        for key in _longer(ids, rules):
            left = F.replace(left, F.lit(key), F.lit("<>"))
        return F.when(F.contains(left, F.lit(_key(ids))), name)

    names = F.array_compact(F.array(*(won(name, ids) for name, ids in rules)))
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(names))).otherwise(none))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: licences and recognised sentences per document."""
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    values = ", ".join(f"('{text}', '{name}')" for name, text in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{_key(ids)}', [{', '.join(map(repr, _longer(ids, RULES)))}]::varchar[])" for name, ids in RULES)
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOW}'), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
with known(t, id) as (values {values}), rules(name, ids, longer) as (values {rules}),
s as (select doc_id, unnest(regexp_split_to_array(text, '[.;:!?]+[ \t\n\r\f]+')) as s, generate_subscripts(regexp_split_to_array(text, '[.;:!?]+[ \t\n\r\f]+'), 1) as i from documents),
whole as (select doc_id, i, 0 as j, id from s join known on t = {norm("s")}),
line as (select doc_id, i, unnest(string_split(s, chr(10))) as l, generate_subscripts(string_split(s, chr(10)), 1) as j from s where {norm("s")} not in (select t from known)),
hits as (select * from whole union all select doc_id, i, j, id from line join known on t = {norm("l")}),
seq as (select doc_id, string_agg(id, ',' order by i, j) as shown, string_agg('<' || id || '>', '' order by i, j) as ids, count(*) as n from hits group by doc_id),
won as (select doc_id, string_agg(distinct name, ',' order by name) as licenses from seq join rules
  on contains(list_reduce(list_prepend(seq.ids, longer), lambda x, y: replace(x, y, '<>')), rules.ids) group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(shown, '') as sentence_ids, coalesce(licenses, '') as licenses
from documents d left join seq using (doc_id) left join won using (doc_id)
"""


ORACLE = _oracle()
