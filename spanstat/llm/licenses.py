"""License scan: known license sentences, then ordered rules over their ids.

In DataFrame functions only. A text is cut into pieces at line ends and after
. ! ? or ; with white space behind; marks at line starts (comments, lists) go, and a
piece is normalised to lower-case letters and digits with single spaces. A known
sentence is one piece, or several of a paragraph in a row, as in wrapped texts. The
ids of the known sentences of a text, in order, are matched against rules, each an
ordered run of ids.

Covered: MIT, BSD-2-Clause, BSD-3-Clause, ISC and Unlicense by text; Apache-2.0,
GPL-2.0, GPL-3.0, LGPL-2.1, AGPL-3.0, MPL-2.0, CC-BY-4.0, CC-BY-NC-4.0 and CC-BY-SA-4.0
by notice; SPDX tags of these, LGPL-3.0 and CC0-1.0; "All rights reserved". Any other
license, and the full texts of those that are known by notice, give none. Sentences of
the table end where a text is cut, so a notice with an inner ; or "v. 2.0" has parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (id, sentence) of license texts and notices, as published.
SENTENCES = (
    (1, "Released under the MIT License."),
    (2, "Licensed under the MIT License."),
    (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    (4, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (5, "Licensed under the Apache License, Version 2.0."),
    (6, "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    (7, "you may not use this file except in compliance with the License."),
    (8, "You may obtain a copy of the License at"),
    (9, "This work is licensed under the GNU General Public License, version 3."),
    (10, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (11, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    (12, "Licensed under CC BY-NC 4.0."),
    (13, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (14, "Licensed under CC BY 4.0."),
    (15, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (16, "All rights reserved."),
    (17, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (18, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (19, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (21, "SPDX-License-Identifier: MIT"),
    (22, "SPDX-License-Identifier: Apache-2.0"),
    (23, "SPDX-License-Identifier: BSD-2-Clause"),
    (24, "SPDX-License-Identifier: BSD-3-Clause"),
    (25, "SPDX-License-Identifier: GPL-2.0-only"),
    (26, "SPDX-License-Identifier: GPL-2.0-or-later"),
    (27, "SPDX-License-Identifier: GPL-3.0-only"),
    (28, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (29, "SPDX-License-Identifier: LGPL-3.0-or-later"),
    (30, "SPDX-License-Identifier: AGPL-3.0-or-later"),
    (31, "SPDX-License-Identifier: MPL-2.0"),
    (32, "SPDX-License-Identifier: ISC"),
    (33, "SPDX-License-Identifier: Unlicense"),
    (34, "SPDX-License-Identifier: CC0-1.0"),
    (35, "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    (36, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (37, "This is free and unencumbered software released into the public domain."),
    (38, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (39, "either version 2.1 of the License, or (at your option) any later version."),
    (40, "either version 2 of the License, or (at your option) any later version."),
    (44, "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"),
    (45, "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    (41, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (42, "Licensed under CC BY-SA 4.0."),
    (43, "Licensed under the MIT License, see LICENSE."),
    (20, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)

#: Fixed values: (license, ids in their order), the more specific ones first.
RULES = (
    ("MIT", (3, 4)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (21,)),
    ("MIT", (43,)),
    ("Apache-2.0", (22,)),
    ("GPL-2.0", (25,)),
    ("GPL-2.0", (26,)),
    ("GPL-2.0", (45, 40)),
    ("GPL-3.0", (27,)),
    ("GPL-3.0", (28,)),
    ("LGPL-2.1", (44, 39)),
    ("LGPL-3.0", (29,)),
    ("AGPL-3.0", (30,)),
    ("AGPL-3.0", (38,)),
    ("MPL-2.0", (31,)),
    ("MPL-2.0", (35,)),
    ("ISC", (32,)),
    ("ISC", (36,)),
    ("Unlicense", (33,)),
    ("Unlicense", (37,)),
    ("CC0-1.0", (34,)),
    ("CC-BY-SA-4.0", (41,)),
    ("CC-BY-SA-4.0", (42,)),
    ("BSD-2-Clause", (23,)),
    ("BSD-3-Clause", (24,)),
    ("Apache-2.0", (6, 7, 8)),
    ("Apache-2.0", (5,)),
    ("GPL-3.0", (10, 11)),
    ("GPL-3.0", (9,)),
    ("CC-BY-NC-4.0", (12,)),
    ("CC-BY-NC-4.0", (13,)),
    ("CC-BY-4.0", (14,)),
    ("CC-BY-4.0", (15,)),
    ("BSD-3-Clause", (17, 18, 19, 20)),
    ("BSD-2-Clause", (17, 18, 19)),
    ("All-rights-reserved", (16,)),
)

#: A line end with what stands between it and the next line's first word: comment and list marks.
STARTS = r"[ \t\x0B\f\r]*+\n[^a-z0-9\n]*+(?:(?:[0-9]{1,2}|[a-z])\)[^a-z0-9\n]++|(?:rem|dnl)[ \t]++)?+"


def normal(sentence: str) -> str:
    """The Python twin of the normalisation, for the table of known sentences."""
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).split())


def known() -> dict[str, int]:
    return {normal(s): i for i, s in SENTENCES}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licenses (comma-separated), n_sentences of each row.

    sentence_ids holds the known sentences in order, as often as they stand there;
    licenses the distinct names of all rules that match, in alphabetical order,
    except a two-clause BSD match where the three-clause one matches. A null or
    empty text has none ('' and 0).
    """
    table = known()
    ids = ", ".join(f"'{s}', {i}" for s, i in table.items())
    # Each piece ends with a line end, a blank line has two; longer sentences are tried first.
    spread = "|".join(s.replace(" ", r"[ \n]") for s in sorted(table, key=len, reverse=True))
    d = docs.select("doc_id", F.concat(F.lit("\n"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit("\n")).alias("t"))
    d = d.withColumn("t", F.expr(rf"regexp_replace(t, r'{STARTS}', '\n')"))
    d = d.withColumn("t", F.expr(r"regexp_replace(regexp_replace(t, r'[.!?;][ \t\x0B\f\r]+', '\n'), r'[^a-z0-9\n]+', ' ')"))
    d = d.withColumn("t", F.expr(r"replace(replace(t, ' \n', '\n'), '\n ', '\n')"))
    d = d.withColumn("s", F.expr(rf"regexp_extract_all(t, r'\n({spread})(?=\n)', 1)"))
    d = d.withColumn("ids", F.expr(rf"transform(s, x -> map({ids})[replace(x, '\n', ' ')])"))
    d = d.withColumn("sentence_ids", F.array_join("ids", ",")).withColumn("run", F.concat(F.lit(","), "sentence_ids", F.lit(",")))
    hits = [F.when(F.col("run").contains("," + ",".join(map(str, seq)) + ","), F.lit(name)) for name, seq in RULES]
    d = d.withColumn("hits", F.array_distinct(F.array_compact(F.array(*hits))))
    d = d.withColumn("hits", F.when(F.array_contains("hits", "BSD-3-Clause"), F.array_remove("hits", "BSD-2-Clause")).otherwise(F.col("hits")))
    return d.select("doc_id", "sentence_ids", F.array_join(F.sort_array("hits"), ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"))


def oracle() -> str:
    """DuckDB SQL for ``scan`` over the view documents."""
    table = known()
    rows = ", ".join(f"('{s}', {i})" for s, i in table.items())
    rules = ", ".join(f"('{name}', ',{','.join(map(str, seq))},')" for name, seq in RULES)
    return rf"""
with base as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
cut as (select r, unnest(string_split(regexp_replace(t, '([.!?;])[ \t\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10))) as s, generate_subscripts(string_split(regexp_replace(t, '([.!?;])[ \t\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)), 1) as i from base),
norm as (select r, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as s from cut),
found as (select r, i, k.id from norm join (values {rows}) k(s, id) using (s)),
runs as (select r, string_agg(cast(id as varchar), ',' order by i) as ids, count(*) as n from found group by r),
hits as (select distinct r, name from runs, (values {rules}) k(name, seq) where contains(',' || ids || ',', seq)),
names as (select r, string_agg(name, ',' order by name) as licenses from hits h
  where not (name = 'BSD-2-Clause' and exists (select 1 from hits g where g.r = h.r and g.name = 'BSD-3-Clause')) group by r)
select doc_id, coalesce(ids, '') as sentence_ids, coalesce(licenses, '') as licenses, cast(coalesce(n, 0) as bigint) as n_sentences
from base left join runs using (r) left join names using (r)"""
