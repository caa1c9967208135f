"""Cases in which an operator once did less than its whole job."""

import collections
import itertools
import random

import pandas as pd
import pyarrow as pa
import pytest

from fieldweave.llm import license_scan, ngram_join, passages
from fieldweave.sources.shared import BATCH_BYTES, Scratch

from .edge import PROSE, edge_docs
from .test_arrow import groups


def crowded_passages(seed=11, n=300):
    """Own words around one common line that most texts hold with an edit or two."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    line, out = [word() for _ in range(40)], []
    for _ in range(n):
        w = list(line)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = word() if rng.random() < 0.5 else rng.choice(["alpha", "beta", "gamma"])
        out.append(" ".join([*(word() for _ in range(rng.randint(0, 12))), *w, *(word() for _ in range(rng.randint(0, 12)))]))
    return out


def test_all_near_equal_paragraphs_of_a_band_are_linked(spark, monkeypatch):
    texts = crowded_passages()
    sets, held = {}, collections.defaultdict(set)
    for p in passages.paragraphs(texts):
        for t, at, end, node in zip(p.text, p.offset, [*p.offset[1:], len(p.run)], p.node.view("int64"), strict=True):
            sets[int(node)] = set(p.run[at:end].tolist())
            held[int(node)].add(int(t))
    bands = collections.defaultdict(set)
    for rows in passages._bands(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])):
        for key, node in zip(rows["key"], rows["node"], strict=True):
            bands[key].add(int(node))
    nodes = sorted(sets)
    place = {node: i for i, node in enumerate(nodes)}
    pairs = {pair for b in bands.values() for pair in itertools.combinations(sorted(b), 2)}
    links = [(place[a], place[b]) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    docs = collections.defaultdict(set)
    for node, least in zip(nodes, groups(len(nodes), links), strict=True):
        docs[least] |= held[node]
    expected = {(t, len(ds), t != min(ds)) for ds in docs.values() if len(ds) > 1 for t in ds}

    monkeypatch.setattr(passages, "MIN_RUN", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    clusters = {(r.cluster_id, r.n_docs) for r in got}
    assert {r.doc_id for r in got} == {t for t, _, _ in expected}
    assert {n for _, n in clusters} <= {n for _, n, _ in expected}
    assert max(n for _, n in clusters) == max(n for _, n, _ in expected)


def test_hardly_any_pair_across_components_is_formed_but_links(spark, monkeypatch):
    """A long paragraph with another word near its end in each text: four shingles of two sets
    differ, two may. In 64 slots, so many fall on others' bits that a part of all pairs passes."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20_000)]
    p = next(passages.paragraphs([" ".join(words)]))
    longest = (p.end - p.start).argmax()
    line = words[p.start[longest] : p.end[longest]]
    texts = [" ".join([*line[:-2], "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)), line[-1]]) for _ in range(200)]
    p = next(passages.paragraphs(texts))
    sets = {node: set(p.run[a:b].tolist()) for node, a, b in zip(p.node, p.offset, [*p.offset[1:], len(p.run)], strict=True)}
    links = sum(100 * len(x & y) >= 75 * len(x | y) for x, y in itertools.combinations(sets.values(), 2))

    formed, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a: (out := keep(self, df, name, *a), formed.append(out.count()) if name == "across" else None)[0])
    passages.paragraph_clusters(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "test"))
    assert len(formed) == 1 and formed[0] <= links + 100


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_links_of_all_paragraphs(spark, sf):
    """Links of the query's clusters against an exact join of all paragraphs, and its rows
    against runs made by hand of those clusters."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets, held, parts = {}, collections.defaultdict(set), []
    for p in passages.paragraphs([r.text for r in rows]):
        ends = [*p.offset[1:], len(p.run)]
        for t, a, b, at, end, node in zip(p.text, p.start, p.end, p.offset, ends, p.node.view("int64"), strict=True):
            sets[int(node)] = frozenset(p.run[at:end].tolist())
            held[int(node)].add(rows[t].doc_id)
            parts.append((rows[t].doc_id, int(a), int(b), int(node)))
    by = collections.defaultdict(list)
    for node, s in sets.items():
        for g in s:
            by[g].append(node)
    shared = collections.Counter(pair for nodes in by.values() for pair in itertools.combinations(sorted(nodes), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]

    scratch = Scratch(spark, "test")
    _, clusters = passages.paragraph_clusters(docs.select("doc_id", "text"), scratch)
    of = {r.node: r.cluster_id for r in clusters.collect()}
    assert sum(of.get(a, a) == of.get(b, b) for a, b in links) >= 0.95 * len(links)
    place = {node: k for k, node in enumerate(sorted(sets))}
    exact = groups(len(sets), [(place[a], place[b]) for a, b in links])
    first = {}
    assert all(exact[place[node]] == exact[place[first.setdefault(c, node)]] for node, c in of.items())

    members = collections.defaultdict(set)
    for node, ds in held.items():
        members[of.get(node, node)] |= ds
    runs = []
    for (doc, removed), own in itertools.groupby(
        sorted((d, d != min(members[of.get(n, n)]), a, b, of.get(n, n)) for d, a, b, n in parts if len(members[of.get(n, n)]) > 1), key=lambda x: x[:2]
    ):
        for _, _, a, b, c in own:
            if runs and runs[-1][:2] == [doc, removed] and a - runs[-1][3] <= passages.WINDOW:
                runs[-1][3] = max(b, runs[-1][3])
            else:
                runs.append([doc, removed, a, b, c])
    expected = {(d, a, b, c, len(members[c]), removed) for d, removed, a, b, c in runs if b - a >= passages.MIN_RUN}
    got = passages.digest(docs).collect()
    assert {(r.doc_id, r.start, r.end, r.cluster_id, r.n_docs, r.removed) for r in got} == expected and len(got) == len(expected)


def test_removed_passages_are_cut_out(spark):
    text = "one two  three\nfour five"
    df = spark.createDataFrame([(text, [(1, 3)]), (text, [(0, 1), (4, 9)]), (None, [(0, 1)]), (text, None)], "text string, cuts array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(passages._cut_out("text", "cuts")).collect()]
    assert got == ["one \nfour five", " two  three\nfour ", None, text]
    docs = edge_docs(spark)
    out = {r.doc_id: r.text for r in passages.without_passages(docs).where("doc_id in (6, 8, 10)").collect()}
    assert out[6] == PROSE and len(out[8].split()) < 10 and out[10] == "\x0b\x0c x \r\n y" and passages.without_passages(docs).columns == docs.columns


def test_rows_without_a_doc_id_stay(spark):
    big = 2**60 + 1
    more = [(None, PROSE, "en"), (None, PROSE, "en"), (None, None, "en"), (big, "five more words stand here alone", "en"), (None, "own", None)]
    rows = [(i, t, lang, "src", len(t or ""), "node") for i, t, lang in more]
    docs = edge_docs(spark)
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).coalesce(1)
    got = ngram_join.digest(docs).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id == big} == {big}
    n = ngram_join.shingle_sets([PROSE])
    size = len(next(n)[1])
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 1, size, size]
    assert all(r.component_id is None and r.class_id is None for r in got if r.doc_id is None)
    kept = ngram_join.one_of_each(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 4 and {6, 1, big} <= {r.doc_id for r in kept} and 7 not in {r.doc_id for r in kept}
    assert not [r for r in passages.digest(docs).collect() if r.doc_id is None]


WRAPPED = {
    "x\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n": "MIT",
    "# Redistribution and use in source and binary forms, with or without\n#\n# modification, are permitted provided that the following conditions\n# are met:": "BSD",
    "Licensed under the\nApache License,\nVersion 2.0\n": "Apache-2.0", "MIT License": "MIT", "The MIT License (MIT)": "MIT", "// SPDX-License-Identifier: MIT\nint x;": "MIT",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "She renewed her license at MIT.": "unknown", "one\ntwo\nthree": "none",
}


def test_wrapped_notices_and_short_names(spark):
    rows = list(enumerate(WRAPPED))
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(WRAPPED.values()))


def test_wide_rows_cross_to_python_in_small_batches(spark):
    """What an executor holds outside its heap is bounded by bytes; the session's setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    wide = spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 3000) AS text").mapInArrow(sizes, "size long")
    rows = [r.size for r in Scratch(spark, "test").keep(wide, "wide").collect()]
    assert sum(rows) >= 18_000_000 and max(rows) <= BATCH_BYTES + 100_000
    assert spark.conf.get(name) == before
