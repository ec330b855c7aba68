"""The training-data queries against plain versions over whole small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanstat.llm import bpe, hnsw, licenses, pack, probminhash, quality, substrings, token_files, toxicity
from spanstat.llm.queries import oracle_sql, queries
from spanstat.llm.tokens import ids_bytes, tokenizer_path
from tests.compare import oracle, spark_rows

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a"), (4, "x" * 5000), (5, "a b c\n\n a b c"), (5, "a b c\n\n a b c"), (6, "naïve <|endoftext|> ☃ 1,000's\tend ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def files(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(queries()[name](spark, SF)) == oracle(oracle_sql()[name], SF)


def test_bpe(spark, docs, tok, tmp_path):
    for got, rows in ((queries()["op7_bpe"](spark, SF), docs), (bpe.encode_decode(files(spark, tmp_path, ODD)), ODD)):
        want = Counter()
        for i, text in rows:
            ids = tok.encode(text or "", add_special_tokens=False).ids
            decoded = tok.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(ids_bytes(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_token_counts(spark, docs, tok, tmp_path):
    got = Counter(tuple(r) for r in queries()["op1_token_counts"](spark, SF).select("doc_id", "n_tokens").collect())
    bpe_counts = Counter(tuple(r) for r in queries()["op7_bpe"](spark, SF).select("doc_id", "n_tokens").collect())
    assert got == bpe_counts
    want = Counter((i, len(tok.encode(text or "", add_special_tokens=False).ids)) for i, text in ODD)
    odd = files(spark, tmp_path, ODD)
    for file_docs in (1, 2, 20_000):
        assert Counter(tuple(r) for r in token_files.token_counts(odd, file_docs=file_docs).select("doc_id", "n_tokens").collect()) == want
    assert token_files.token_counts(files(spark, tmp_path, [])).collect() == []


def packed(rows, texts, tok):
    want = {}
    for i, text in texts:
        want.setdefault(i, []).append(tok.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, ps in pieces.items():
        assert sum(p.length for p in ps) == sum(map(len, want[i]))
        for p in ps:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids_bytes(ids[p.start : p.start + p.length])) == p.ids_crc32 for ids in want[i])
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return len(seqs)


def test_packing(spark, docs, tok, tmp_path):
    packed(queries()["op5_packing"](spark, SF).collect(), docs, tok)
    packed(pack.pack(files(spark, tmp_path, ODD)).collect(), ODD, tok)
    assert pack.pack(files(spark, tmp_path, [])).count() == 0


def repeats(rows, length=100):
    seen, out = set(), Counter()
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cut = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                cut[a : a + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~cut])
        spans = int((cut & ~np.r_[False, cut[:-1]]).sum()) if len(b) else 0
        out[i, len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings(spark, docs, tmp_path):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in queries()["op4_substrings"](spark, SF).select(*cols).collect()) == repeats(docs)
    rows = [(1, "x" * 5000), (2, None), (3, ""), (4, "ab" * 300), (5, "y" * 99), (6, "y" * 101), (7, "é" * 50), (8, "é" * 51)]
    assert Counter(tuple(r) for r in substrings.removed(files(spark, tmp_path, rows)).select(*cols).collect()) == repeats(rows)


@pytest.mark.parametrize("batch", [2, 1000])
@pytest.mark.parametrize("entries", [2, 2000])
def test_substrings_of_many_entries(spark, tmp_path, entries, batch):
    # Common lines with own text around them, copies, repeated ids and rows, long texts.
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    line, copy = prose(30), prose(60)
    rows = [(int(i), f"{prose(int(rng.integers(1, 30)))} {line} {prose(int(rng.integers(1, 30)))}") for i in rng.permutation(60)]
    rows += [(100 + i, copy) for i in range(5)] + [(105, copy[:150] + "X" + copy[151:]), (106, "ab" * 40000 + line), (106, None), (107, prose(9000))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        got = Counter(tuple(r) for r in substrings.removed(files(spark, tmp_path, rows), entries=entries).select(*cols).collect())
        assert got == repeats(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_substrings_of_a_common_line(spark, tmp_path):
    # Its windows stay together: as single ones they would fill an executor's memory.
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    line = prose(9)
    rows = [(i, f"{prose(20)} {line} {prose(20)}") for i in range(300)] + [(300 + i, f"{prose(20)} {line} {line}") for i in range(30)]
    docs = files(spark, tmp_path, rows)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in substrings.removed(docs, entries=20).select(*cols).collect()) == repeats(rows)
    found = substrings.spans(docs, 100, 20, [])[1].selectExpr("sum(size(found))").first()[0]
    assert found <= 8 * len(rows), found


def test_substrings_dedup(spark, tmp_path):
    long = " ".join(f"é{i}" for i in range(60))
    rows = [(1, long, 5, "u", 7), (2, long + " end", 6, "v", 8), (3, None, 0, None, 9), (None, "x", 1, "w", 1)]
    schema = "doc_id long, text string, n_chars long, _uid string, found int"
    got = sorted((tuple(r) for r in substrings.dedup(files(spark, tmp_path, rows, schema)).collect()), key=str)
    cut = long.encode()[0:0] + b" end"
    assert got == sorted([(1, long, 5, "u", 7), (2, cut.decode(), 4, "v", 8), (3, None, 0, None, 9), (None, "x", 1, "w", 1)], key=str)
    assert substrings.dedup(files(spark, tmp_path, [], schema)).collect() == []


def union(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_embeddings(spark, tmp_path):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect())
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    comp = union(len(x), np.argwhere(close))
    want = {(r.vec_id, int(close[i].sum()), rows[comp[i]].vec_id, comp[i] == i) for i, r in enumerate(rows)}
    got = {tuple(r) for r in queries()["op3_embeddings"](spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert got == want
    odd = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 0.0]), (4, None, [1.0, 0.0]), (5, 1, None), (6, 1, [float("nan"), 1.0]), (7, 2, [1.0, 0.0])]
    small = hnsw.near_duplicates(files(spark, tmp_path, odd, "vec_id long, label int, embedding array<float>"))
    assert {(r.vec_id, r.n_links, r.component_id) for r in small.collect()} == {(1, 1, 1), (2, 1, 1), *((i, 0, i) for i in range(3, 8))}


def planted(rng, rows, dim, hot, clusters):
    """Unit vectors: a hot cluster, clusters of two to six, and single ones."""
    x = rng.normal(size=(rows, dim))
    at = 0
    for size in [hot, *rng.integers(2, 7, clusters)]:
        x[at : at + size] = x[at] + rng.normal(size=(size, dim)) * np.linalg.norm(x[at]) * rng.uniform(0.02, 0.2) / np.sqrt(dim)
        at += size
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x[rng.permutation(rows)]


@pytest.mark.parametrize("rows", [1, 2, 700])
def test_stored_graph(rows):
    x = planted(np.random.default_rng(8), rows, 16, min(rows, 40), 0)
    graph = hnsw.Graph(x)
    again = hnsw.Graph.of(x, graph.neighbours())
    assert [m.tolist() for m in graph.members] == [m.tolist() for m in again.members]
    for a, b in zip(graph.links, again.links):
        assert [sorted(r[r >= 0].tolist()) for r in a] == [sorted(r[r >= 0].tolist()) for r in b]
    made = hnsw.made_probes(x, 0.93, 50)
    assert np.allclose(np.linalg.norm(made, axis=1), 1) and ((made @ x.T).max(axis=1) >= 0.93 - 1e-9).all()


@pytest.mark.parametrize("hot", [2, 2700])
def test_embedding_audit(monkeypatch, hot):
    x = planted(np.random.default_rng(1), 12_000, 24, hot, 30)
    base, own = x[:8192], np.r_[np.arange(8192), np.full(len(x) - 8192, -1)]
    within = hnsw.Graph.within

    def narrow(self, q, threshold, beam):
        # A beam under 96 loses the links of small clusters, all but a row's own.
        found = within(self, q, threshold, beam)
        return found & ((found.sum(axis=1, keepdims=True) > 100) | (q @ self.x.T > 1 - 1e-9)) if beam < 96 else found

    monkeypatch.setattr(hnsw.Graph, "within", narrow)
    true = x @ base.T >= 0.93
    true[np.arange(8192), np.arange(8192)] = False
    n, _, _ = hnsw.search_shard(hnsw.Graph(base), np.ones(8192, np.int64), x, own, 0.93, 0.999)
    some = true.any(axis=1)
    assert (n <= true.sum(axis=1)).all() and (n[some] / true.sum(axis=1)[some]).mean() >= 0.999
    # No link in the shard but one: found, though no sample meets it.
    far = np.linalg.qr(np.random.default_rng(2).normal(size=(400, 400)))[0]
    far = np.r_[far, far[:1]]
    n, _, _ = hnsw.search_shard(hnsw.Graph(far[:400]), np.ones(400, np.int64), far[400:], np.full(1, -1), 0.93, 0.999)
    assert n.tolist() == [1]


def test_embeddings_over_shards(spark, tmp_path):
    x = planted(np.random.default_rng(4), 18_000, 24, 2700, 1500)
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    links = np.concatenate([(x[lo : lo + 1000] @ x.T >= 0.93).sum(axis=1) - 1 for lo in range(0, len(x), 1000)])
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(spark.read.parquet(str(tmp_path / "in"))).collect()}
    n = np.array([got[i] for i in range(len(x))])
    some = links > 0
    recall = (n[some] / links[some]).mean()
    print(f"recall {recall:.6f} of {some.sum()} rows, links {n.sum()} of {links.sum()}")
    assert (n <= links).all() and recall >= 0.999


def test_embeddings_of_a_whole_shard(monkeypatch):
    # Rows that stand in the graph need no search by a beam again, and miss no link that one missed.
    x = planted(np.random.default_rng(12), 12_000, 64, 300, 1500)
    graph, calls, within = hnsw.Graph(x), [], hnsw.Graph.within
    monkeypatch.setattr(hnsw.Graph, "within", lambda self, q, threshold, beam: calls.append(len(q)) or within(self, q, threshold, beam))
    n, one, root = hnsw.search_shard(graph, np.ones(len(x), np.int64), x, np.arange(len(x)), 0.93, 0.999)
    true = np.concatenate([(x[lo : lo + 1000] @ x.T >= 0.93).sum(axis=1) - 1 for lo in range(0, len(x), 1000)])
    some = true > 0
    assert (n <= true).all() and (n[some] / true[some]).mean() >= 0.999
    assert sum(calls) < len(x) / 10, sum(calls)
    # Both ends of a pair come to one root.
    assert all(root[i] == root[k] for i, k in enumerate(one) if k >= 0)


def test_embeddings_over_small_shards(spark, tmp_path):
    x = planted(np.random.default_rng(4), 9_000, 24, 900, 700)
    spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "in"))
    links = np.concatenate([(x[lo : lo + 1000] @ x.T >= 0.93).sum(axis=1) - 1 for lo in range(0, len(x), 1000)])
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(spark.read.parquet(str(tmp_path / "in")), shard_rows=3000).collect()}
    n = np.array([got[i] for i in range(len(x))])
    some = links > 0
    print(f"recall {(n[some] / links[some]).mean():.6f} of {some.sum()} rows, links {n.sum()} of {links.sum()}")
    assert (n <= links).all() and (n[some] / links[some]).mean() >= 0.999


def test_near_duplicates(spark, tmp_path):
    base = [f"w{i}" for i in range(120)]
    near = [*base[:119], "other"]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(f"z{i}" for i in range(90))), (5, None), (6, "")]
    got = {r.doc_id: (r.class_id, r.kept) for r in probminhash.classes(files(spark, tmp_path, rows)).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True), 6: (6, True)}


def test_near_duplicates_with_unequal_repeats(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        body = [f"b{g}x{i}" for i in range(400)]
        line = [f"l{g}x{i}" for i in range(12)]
        for k, times in enumerate((1, 50, 200, 700)):
            words = list(body)
            for at in rng.choice(400, k, replace=False):
                words[at] = f"new{g}x{k}x{at}"
            rows.append((4 * g + k, " ".join(words + line * times)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    comp = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert len(set(comp)) == 25
    got = {r.doc_id: (r.class_id, r.kept) for r in probminhash.classes(files(spark, tmp_path, rows)).collect()}
    assert got == {i: (comp[i], comp[i] == i) for i in range(len(rows))}


def test_toxicity_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries()["op2_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    known = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9, auc


def test_html(spark, tmp_path):
    html = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><p>" + "Long words &amp; more, of an article's text. " * 8 + "</p><p>Second  one\nhere.</p></article><footer>foot</footer></body></html>"
    from spanstat.llm import html_text

    got = {r.page_id: r.text for r in html_text.extract(files(spark, tmp_path, [(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")).collect()}
    assert got == {1: ("Long words & more, of an article's text. " * 8).strip() + "\nSecond one here.", 2: "", 3: ""}


@pytest.fixture(scope="module")
def scorer(spark):
    counts = toxicity.character_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))
    for w in ("worthless", "idiot"):
        c = toxicity.classes_of(f"  {w}  ")
        for a, b, k in zip(c, c[1:], c[2:]):
            at = int((a * toxicity.CLASSES + b) * toxicity.CLASSES + k)
            counts[at] = counts.get(at, 0) + 300
    return toxicity.Scorer(counts, {"worthless": 5.0, "worthl*": 5.0, "idiot": 5.0}, (0.0, 1.0, 0.0))


@pytest.mark.parametrize("text", [*(s.join(w) for w in ("worthless", "idiot") for s in sorted(toxicity.SPACERS)), *(f" {s} ".join("worthless") for s in "/,:'"), "wor'thless", "iiddiioott", "wworrthlless", "wor thless", "idi ot", "w0rthle55", "worthle$$", "1diot", "id1ot"])
def test_toxicity_of_obfuscated_words(scorer, text):
    assert scorer.evidence(f"plain {text} end")[0] == 5.0, scorer.restorer.words(text)


def test_toxicity_of_plain_words(scorer):
    assert scorer.evidence("or/and a book, letters: don't be idle.")[0] == 0.0


P = "<p>" + "Long words of an article's text, with a stop. " * 6 + "</p>"
SIDE = "<p>Buy this thing now.</p>"


@pytest.mark.parametrize("attributes", ['class="content has-sidebar"', 'class="no-sidebar"', 'id="main-side"', 'title="The hidden valley"', 'data-hidden="false"', 'data-class="ad"', "data-x='a hidden b'", 'aria-hidden="false"', 'class="sidebar"', 'class="comments"', 'role="form"'])
def test_html_keeps_wrappers(attributes):
    from spanstat.llm.html_text import extract_text

    want = ("Long words of an article's text, with a stop. " * 6).strip()
    assert extract_text(f"<body><div {attributes}>{P}</div></body>") == want
    assert extract_text(f"<body><form><div {attributes}><article>{P}</article></div></form></body>") == want


@pytest.mark.parametrize("attributes", ['class="ad"', 'class="box sidebar"', 'id="cookie-banner"', 'class="site-footer"', "hidden", 'hidden=""', 'style="color:red; display: none"', 'aria-hidden="true"', "role=navigation", "class=ad"])
def test_html_cuts(attributes):
    from spanstat.llm.html_text import extract_text

    want = ("Long words of an article's text, with a stop. " * 6).strip()
    assert extract_text(f"<body><div>{P}<div {attributes}>{SIDE}</div></div></body>") == want


def test_html_keeps_hidden_links():
    from spanstat.llm.html_text import extract_text

    text = P.replace("Long words", '<a href="/hidden-valley">Long</a> words', 1)
    assert extract_text(f"<body><div>{text}</div></body>") == extract_text(f"<body><div>{P}</div></body>")
    # An article that is shorter than a marked block stays.
    both = extract_text(f"<body><form><article><p>Short but whole.</p></article></form><div class=comments>{P}</div></body>")
    assert "Short but whole." in both


MIT = """MIT License

Copyright (c) 2024 A. Author
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_wrapped_licenses(spark, tmp_path):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + CLAUSE, "GPL-3.0": GPL}
    marks = ["", "# ", " * ", "// ", ";; ", "-- ", "dnl "]
    rows, want = [], []
    for name, text in texts.items():
        for t in [*("".join(m + line + "\n" for line in text.split("\n")) for m in marks), text.replace("\n", "\r\n"), text.replace("1. ", "1) ").replace("2. ", "* ")]:
            rows.append((len(rows), t))
            want.append(name)
    cut = MIT.replace("a copy\nof this", "a copy\n\nof this")
    rows += [(len(rows), cut), (len(rows) + 1, "x Licensed under CC BY 4.0.\nAll rights\nreserved. Released under the MIT License. y")]
    want += ["", "All-rights-reserved,MIT"]
    got = {r.doc_id: r.licenses for r in licenses.scan(files(spark, tmp_path, rows)).collect()}
    assert got == dict(enumerate(want))


def test_quality_of_odd_rows(spark, tmp_path):
    d = files(spark, tmp_path, ODD)
    got = quality.quality(d).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got)
    assert quality.filter_quality(files(spark, tmp_path, [])).count() == 0


MORE = {
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file",
    "MIT": "# SPDX-License-Identifier: MIT",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


def test_further_licenses(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(MORE.values())]
    got = {r.doc_id: r.licenses for r in licenses.scan(files(spark, tmp_path, rows)).collect()}
    assert got == dict(enumerate(MORE))


def test_html_headline():
    from spanstat.llm.html_text import extract_text

    assert extract_text(f"<body><header><a href=/>site</a></header><article><header><h1>Head line</h1></header>{P}</article></body>").startswith("Head line\nLong words")


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_token_files_over_blocks(spark, tmp_path, block):
    ids = [[5, 6, 7], [], [8] * 20, [9]]
    raw = b"".join(np.array([*x, token_files.END_ID], "<u2").tobytes() for x in ids)
    (tmp_path / "a").write_bytes(raw)
    (tmp_path / "b").write_bytes(np.array([1, 2, 3], "<u2").tobytes())
    got = sorted((r.file[-1], r.ordinal, r.start, r.n_tokens) for r in token_files.scan_files(spark, str(tmp_path), block=block).collect())
    assert got == [("a", 0, 0, 3), ("a", 1, 4, 0), ("a", 2, 5, 20), ("a", 3, 26, 1), ("b", 0, 0, 3)]


def test_viterbi_against_all_paths():
    """Restoring a token gives a path that no other one beats."""
    import itertools

    text = "  idiot  stupid  dust  tid  "
    c = toxicity.classes_of(text)
    counts = Counter(int((a * toxicity.CLASSES + b) * toxicity.CLASSES + k) for a, b, k in zip(c, c[1:], c[2:]))
    model = toxicity.CharModel(counts)

    def choices(ch):
        out = [(x, toxicity.SWAPPED) for x in toxicity.LEET.get(ch, "")] + ([(ch, toxicity.SAME)] if ch.isalpha() else [])
        skip = toxicity.SPACED if ch in toxicity.SPACERS else 2 * toxicity.SWAPPED if not ch.isalnum() or not out else None
        return [*((x, cost, again) for x, cost in out for again in (False, True)), *([(None, skip, False)] if skip is not None else [])]

    def best(token):
        found = (-1e9, "")
        for path in itertools.product(*map(choices, token)):
            score, word, fits = 0.0, "", True
            for x, cost, again in path:
                if again:
                    fits = fits and word[-1:] == x
                    score += cost + toxicity.REPEATED
                elif x is None:
                    score += cost
                else:
                    a, b = ([0, 0, *(model.index.get(y, 1) for y in word)])[-2:]
                    score, word = score + cost + model.log[a][b][model.index.get(x, 1)], word + x
            a, b = ([0, 0, *(model.index.get(y, 1) for y in word)])[-2:]
            if fits:
                found = max(found, (score + model.log[a][b][0], word))
        return found[1]

    for token in ("1d10t", "i-d-i", "stuup1d", "du$t", "t!!d", "8x"):
        assert model.restore(token) == best(token), token


@pytest.mark.parametrize("rows", [[], [(1, None, "x", 1), (1, "", "y", 2), (2, "word " * 250_000, "z", 3), (2, "word " * 250_000, "z", 3), (None, "a plain text of some words", None, None)]])
def test_stages_of_odd_rows(spark, tmp_path, rows):
    """Every filtering stage takes empty tables, nulls, 1 MB texts, repeated rows and clashing names."""
    schema = "doc_id long, text string, _uid string, pattern int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = files(spark, tmp_path, rows, schema)
    kinds = {r: i for i, r in enumerate(rows)}
    for stage in (quality.filter_quality, lambda x: toxicity.filter_toxic(x, labels), probminhash.dedup):
        out = stage(d)
        assert out.columns == d.columns
        assert {tuple(r) for r in out.collect()} <= kinds.keys()
    assert len(toxicity.filter_toxic(d, labels).collect()) == len(rows)
    assert len(probminhash.dedup(d).collect()) == max(0, len(rows) - 1)
    assert len(substrings.dedup(d).collect()) == len(rows)
    for op in (bpe.encode_decode, quality.quality, licenses.scan, token_files.token_counts, probminhash.classes, substrings.removed):
        assert len(op(d).collect()) == len(rows), op
    pack.pack(d).collect()


def test_pipeline(spark):
    """Each stage keeps the columns; kept rows are those that the operators keep, and every id is packed."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        if name != "substrings":
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}
    good = {r.doc_id for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept.keys() <= good
    # No word run of the near-duplicate rule is left twice: no two texts are equal before the cut of passages.
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation(), tok.no_padding()
    packed(corpus_pipeline.run(spark, SF).collect(), list(kept.items()), tok)
