"""The operators that run Python, against plain Python."""

import collections
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldweave.llm import components, contamination, language_crf, linking, ngram_join, packing, passages, personal_data, shingles
from fieldweave.sources.shared import Scratch

from .edge import EDGE, PROSE, edge_docs, empty_docs
from .test_native import WORD


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def grams(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(n, links):
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


@given(st.lists(st.text("aB \n\té学", max_size=40), max_size=5))
def test_shingle_sets(texts):
    got = dict(shingles.shingle_sets(texts))
    assert {i: len(s) for i, s in got.items()} == {i: len(grams(t)) for i, t in enumerate(texts)}
    for i, j in itertools.combinations(got, 2):
        assert shingles.common(got[i], got[j]) == len(grams(texts[i]) & grams(texts[j]))


@given(st.sets(st.integers(0, 1 << 40), max_size=60), st.sets(st.integers(0, 1 << 40), max_size=60))
def test_cut_sets_bound_the_overlap(a, b):
    cut = lambda x: np.sort(np.array(sorted(x), np.uint64).astype(np.uint16))
    assert len(a & b) <= ngram_join.at_most(cut(a), cut(b)) <= min(len(a), len(b))


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=100, deadline=None)
def test_sketches_differ_no_more_than_sets(both, a, b):
    x, y = (ngram_join.sketch(np.array(sorted(both | s), dtype=np.uint64)) for s in (a, b))
    assert len(x) == len(ngram_join.SKETCH)
    assert sum(((u ^ v) & (2**64 - 1)).bit_count() for u, v in zip(x, y, strict=True)) <= len((both | a) ^ (both | b))


def near_copies(seed=3, n=160):
    """Texts with exact copies, copies at every distance, a passage in many, and loners."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["ba", "do", "ki", "lu", "ne"]) + rng.choice(["r", "s", "t", "x"]) + str(rng.randint(0, 60))
    passage = [word() for _ in range(12)]
    bases = [[word() for _ in range(rng.randint(3, 90))] for _ in range(14)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases)) if i % 4 else [word() for _ in range(30)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if i % 3 == 0:
            w += passage
        out.append(" ".join(w))
    return out + [None, "", " \n ", "one", "One", "x y", out[0].upper()]


def test_ngram_join_finds_every_component(spark):
    texts = near_copies()
    sets = [grams(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = groups(len(texts), links)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.digest(df).collect()}
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)}


def test_ngram_join_edges(spark):
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.digest(edge_docs(spark)).collect())
    assert got[(7, 6)] == 2 and got[(8, 6)] == 1 and got[(1, 1)] == 1 and sum(got.values()) == len(EDGE)
    assert ngram_join.digest(empty_docs(spark)).count() == 0
    kept = ngram_join.one_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 3, 4, 5, 6, 9, 10, 11]


def test_sweep_over_any_batches():
    rows = sorted([(k, n, 5, 0, n) for k, n in ((1, 1), (2, 1), (2, 2), (2, 3), (3, 4), (4, 4), (4, 4), (5, 1), (5, 2))])
    frame = pd.DataFrame(rows, columns=["key", "node", "n", "pos", "c"])
    for size in (1, 2, 3, 9):
        out = pd.concat(list(linking.sweep(frame.iloc[i : i + size] for i in range(0, len(frame), size))))
        assert sorted(zip(out["key"], out["node"], out["pivot"])) == [(2, 1, 1), (2, 2, 1), (2, 3, 1), (5, 1, 1), (5, 2, 1)], size


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 90)]
    least = groups(92, links)
    df = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    got = {r.node: r.component for r in components.components(df, Scratch(spark, "test")).collect()}
    assert got == {i: least[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(df.limit(0), Scratch(spark, "test")).count() == 0


def test_contamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 16, 17, 30, 60, 200])]
    items += [(90, None), (91, " "), (92, items[7][1]), (92, items[7][1])]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.choice([3, 40, 400, 2500]))]
        own = rng.choice(items)[1]
        if own and d % 2:
            part = own.split()
            if d % 5 == 0:
                part[rng.randrange(len(part))] = "zzzz"
            at = rng.randrange(len(w))
            w = w[:at] + part + w[at:]
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (5, docs[5][1])]
    expected = set()
    for d, t in docs:
        for i, x in items:
            q = grams(x)
            m = len(next(iter(q))) if q else 0
            have = grams(t) if m == 5 else grams(t, m) if m and len(WORD.findall(t or "")) >= m else set()
            if q and 100 * len(q & have) >= 75 * len(q):
                expected.add((d, i, len(q & have), len(q)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r)[:4] for r in contamination.contained_items(df, bench).collect()} == expected
    clean = contamination.decontaminate(df, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in expected}
    small = (contamination.ITEM_BLOCK, contamination.BLOCK_BYTES)
    try:
        contamination.ITEM_BLOCK, contamination.BLOCK_BYTES = 4, 300
        assert {tuple(r)[:4] for r in contamination.contained_items(df, bench).collect()} == expected
    finally:
        contamination.ITEM_BLOCK, contamination.BLOCK_BYTES = small
    assert contamination.contained_items(df, bench.limit(0)).count() == 0
    assert contamination.contained_items(empty_docs(spark), bench).count() == 0


def test_contamination_by_text(spark):
    """Items that share an id, null ids on either side, one id with two texts, clashing columns."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    big = 2**60 + 1
    bench = spark.createDataFrame([(1, one, "k"), (1, two, "k"), (None, three, "k")], "item_id long, text string, k1 string")
    docs = spark.createDataFrame(
        [(1, f"x {one} y", "z"), (1, "own words only here", "z"), (2, two, None), (None, f"{three} w", None), (None, "plain", None), (big, one, None), (4, None, None)],
        "doc_id long, text string, item_id string",
    )
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contamination.contained_items(docs, bench).collect()}
    assert got == {(1, 1, 8, 8), (2, 1, 8, 8), (None, None, 8, 8), (big, 1, 8, 8)}
    clean = contamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == ["None", "own words only here", "plain"]


def planted_passages(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    docs = {d: [word() for _ in range(rng.randint(60, 500))] for d in range(160)}
    pairs = []
    for k in range(40):
        passage = [word() for _ in range(rng.randint(51, 90))]
        for d in (2 * k, 2 * k + 1):
            at = rng.randrange(len(docs[d]))
            docs[d] = docs[d][:at] + passage + docs[d][at:]
        pairs.append((2 * k, 2 * k + 1))
    boilerplate = [word() for _ in range(12)]
    for d in range(100, 140):
        docs[d] += ["\n", *boilerplate, "\n"]
    return {d: " ".join(w) for d, w in docs.items()}, pairs


def test_passages_are_found_wherever_they_stand(spark):
    docs, pairs = planted_passages()
    rows = passages.digest(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()
    flagged = collections.defaultdict(set)
    for r in rows:
        flagged[r.doc_id].add(r.removed)
    assert sum(a in flagged and b in flagged for a, b in pairs) >= 38
    assert not [d for d in flagged if d >= 80]
    assert all(True not in flagged.get(a, set()) for a, _ in pairs)
    words = {d: WORD.findall(t) for d, t in docs.items()}
    for r in rows:
        partner = r.doc_id ^ 1
        mine = " ".join(words[r.doc_id][r.start : r.end])
        assert mine in " ".join(words[partner]) and r.n_words == r.end - r.start


def test_paragraphs_against_all_pairs(spark):
    """Every link of the exact join over all paragraphs is in one cluster, but for the bands' misses."""
    texts = [t for t in near_copies(8, 90) if t]
    parts = []
    for p in passages.paragraphs(texts):
        parts += [(int(i), set(x.tolist())) for i, x in zip(p.text, np.split(p.run, p.offset[1:]), strict=True)]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(parts)), 2) if 100 * len(parts[a][1] & parts[b][1]) >= 75 * len(parts[a][1] | parts[b][1])]
    least = groups(len(parts), pairs)
    size = collections.defaultdict(set)
    for p, (i, _) in enumerate(parts):
        size[least[p]].add(i)
    expected = {i for p, (i, _) in enumerate(parts) if len(size[least[p]]) > 1}
    old = passages.MIN_RUN
    try:
        passages.MIN_RUN = 1
        got = {r.doc_id for r in passages.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        passages.MIN_RUN = old
    assert got <= expected and len(got) >= 0.98 * len(expected)


def band_rows(seed=9, n=3000):
    """Band rows: most keys of one node, some of several, one of many, some rows twice."""
    rng = random.Random(seed)
    long = lambda: rng.randrange(-(1 << 63), 1 << 63)
    few, hot = [long() for _ in range(200)], long()
    rows = [(rng.choice([hot, rng.choice(few), long(), long(), long()]), long(), rng.randint(2, 30)) for _ in range(n)]
    return rows + rows[:300]


def shared_rows(rows):
    """(key, node, n) of keys with two nodes or more."""
    nodes = collections.defaultdict(set)
    for key, node, n in rows:
        nodes[key].add((key, node, n))
    return sorted(x for held in nodes.values() if len(held) > 1 for x in held)


def test_keys_of_one_node_never_become_rows(monkeypatch):
    monkeypatch.setattr(linking, "PACK", 500)
    rows = band_rows()
    frame = pd.DataFrame(rows, columns=["key", "node", "n"])
    packed = pd.concat(list(linking.pack((frame.iloc[i : i + 170] for i in range(0, len(frame), 170)), 7))).sort_values("bucket")
    assert set(packed["bucket"]) == set(range(7)) and len(packed) < 60
    out = pd.concat(list(linking.sweep_packed((packed.iloc[i : i + 5] for i in range(0, len(packed), 5)), 10_000)))
    assert out["swept"].all()
    assert sorted(zip(out["key"], out["node"], out["n"], strict=True)) == shared_rows(rows)
    least, size = {}, {node: n for _, node, n in rows}
    for key, node, _ in shared_rows(rows):
        least.setdefault(key, node)
    for key, node, n, pivot, pivot_n in zip(out["key"], out["node"], out["n"], out["pivot"], out["pivot_n"], strict=True):
        m = size[least[key]]
        assert (pivot, pivot_n) == ((least[key], m) if 4 * min(n, m) >= 3 * max(n, m) else (node, n))
    assert not len(linking.sweep_bucket(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)))


@pytest.mark.parametrize("bucket", [1 << 19, 40])
def test_packed_blocks_also_of_overfull_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(linking, "BUCKET", bucket)
    rows = band_rows()
    df = spark.createDataFrame(rows, "key long, node long, n int").repartition(3)
    formed, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a: (formed.append(name), keep(self, df, name, *a))[1])
    found = linking.packed_blocks(df, lambda frames: frames, 1000, Scratch(spark, "test"))
    assert formed == (["buckets"] if bucket > 40 else ["buckets", "blocks"])
    got = found.collect()
    assert found.columns == linking.blocks(df.withColumn("pos", F.lit(0)), Scratch(spark, "test")).columns
    assert sorted((r.key, r.node, r.n) for r in got) == shared_rows(rows)
    pivots = collections.defaultdict(set)
    for r in got:
        pivots[r.key] |= {r.pivot} - {r.node}
    assert all(len(p) <= 1 for p in pivots.values()) and sum(r.pivot != r.node for r in got) > 300


def test_only_sets_to_compare_leave_the_texts(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(400)) for _ in range(100)]
    nodes = np.concatenate([p.node for p in passages.paragraphs(texts)]).view(np.int64)
    wanted = sorted(set(nodes.tolist()))[::50]
    marks = passages.Marks(spark.createDataFrame([(x,) for x in wanted], "node long"), len(wanted))
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    left = pd.concat(list(passages._sets(iter([frame]), marks)))
    assert set(wanted) <= set(left["node"]) and len(left) < len(nodes) / 25
    sets = {int(n): s for p in passages.paragraphs(texts) for n, s in zip(p.node.view(np.int64), np.split(p.run, p.offset[1:]), strict=True)}
    assert all(np.frombuffer(g, np.uint64).tolist() == sorted(set(sets[n].tolist())) for n, g in zip(left["node"], left["grams"], strict=True))
    nothing = passages.Marks(spark.createDataFrame([], "node long"), 0)
    assert not list(passages._sets(iter([frame]), nothing))


def test_passage_edges_and_bands(spark):
    rows = passages.digest(edge_docs(spark)).collect()
    assert {r.doc_id for r in rows} == {6, 7, 8, 12} and [r.doc_id for r in rows if not r.removed] == [6]
    assert passages.digest(empty_docs(spark)).count() == 0
    assert 1 - (1 - 0.75**passages.ROWS) ** passages.tune_bands() >= passages.RECALL
    assert passages.cut_points(np.zeros(0, np.uint64), np.zeros(2, int)).tolist() == []


def test_cuts_do_not_depend_on_the_texts_beside():
    texts = [t for t in near_copies(9, 60) if t]
    cuts = lambda ts: [(int(i), int(a), int(b), int(n)) for p in passages.paragraphs(ts) for i, a, b, n in zip(p.text, p.start, p.end, p.node, strict=True)]
    alone = [(k, a, b, n) for k, t in enumerate(texts) for _, a, b, n in cuts([t])]
    assert cuts(texts) == alone and cuts([*texts, None, ""]) == alone


def base_spans(text):
    import re

    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(m.start(), 1, m.end())] * all(int(x) <= 255 for x in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        out += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and total % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(m.start(), 3, m.end())] * (9 <= sum(c.isdigit() for c in m[0]) <= 15)
    return sorted(out)


@settings(max_examples=400)
@given(st.text("a1.@ -+90()b_5%é", max_size=60))
def test_base_spans_follow_their_expressions(text):
    assert [(s, k, e) for s, k, e, _ in personal_data.find_spans(text) if k < 4] == base_spans(text)


def test_ibans_of_their_length_and_secrets(spark):
    spans = lambda t: [(personal_data.KINDS[k], t[s:e]) for s, k, e, _ in personal_data.find_spans(t) if k > 3]
    assert spans("IBAN DE89370400440532013000 OK thanks") == [("iban", "DE89370400440532013000")]
    assert spans("IBAN: GB82 WEST 1234 5698 7654 32 BIC X") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert spans("DE893704004405320130001") == [] and spans("ZZ89370400440532013000") == []
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert spans(f'token = "{key}" x') == [("secret", key)] and spans(f"commit {key}") == [] and spans("token = " + "a" * 40) == []
    docs = edge_docs(spark).where("doc_id < 3").withColumn("text", F.when(F.col("doc_id") == 2, f'token = "{key}" of a@b.cd, {"é" * 3}').otherwise(F.col("text")))
    masked = personal_data.mask(docs)
    assert masked.columns == docs.columns and {r.doc_id: r.text for r in masked.collect()} == {1: None, 2: 'token = "<secret>" of <email>, ééé'}


def test_added_spans_and_scores():
    found = {personal_data.KINDS[k]: (t[s:e], c) for t in ["iban DE89 3704 0044 0532 0130 00 here", "my ssn is 123-45-6789 ok"] for s, k, e, c in personal_data.find_spans(t)}
    assert found["iban"][0] == "DE89 3704 0044 0532 0130 00" and found["ssn"][0] == "123-45-6789"
    assert not any(k == 5 for _, k, _, _ in personal_data.find_spans("code 123-45-6789 ok"))
    assert not any(k == 4 for _, k, _, _ in personal_data.find_spans("DE88370400440532013000"))
    assert max(c for *_, c in personal_data.find_spans("pay by card 4111 1111 1111 1111")) > max(c for *_, c in personal_data.find_spans("see 4111 1111 1111 1111"))


def test_personal_data_query(spark):
    extra = [(100, "é a.b@c.de +1 (555) 123-4567 and 10.0.0.1, 4111111111111111", "en")]
    rows = [(i, t) for i, t, _ in EDGE + extra]
    for r in personal_data.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = base_spans(dict(rows)[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        full = personal_data.find_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == personal_data.brute_sha(full) and r.spans == ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e, _ in full)
    assert personal_data.digest(empty_docs(spark)).count() == 0


def test_packing(spark, data):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(edge_docs(spark).select(F.col("doc_id") + 10_000, "text"))
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.digest(docs).collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    assert set(by) == set(texts)
    total = 0
    for i, all_rows in by.items():
        ids = np.array([*tokenizer.encode(texts[i][0] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids) * len(texts[i])
        for piece, rows in itertools.groupby(sorted(all_rows, key=lambda r: r.piece), key=lambda r: r.piece):
            rows = list(rows)
            assert len(rows) == len(texts[i])
            for r in rows:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
                assert r.length == 2048 or piece == 0
        assert sum(r.length for r in all_rows) == len(ids) * len(texts[i])
        assert len(all_rows) == len(texts[i]) * -(-len(ids) // 2048)
    for spans in seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seq) <= -(-total // 2048) * 1.02 + 1
    assert packing.digest(empty_docs(spark)).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_supersteps_are_best_fit(counts):
    """The runs place the pieces as best-fit by hand does, one by one, largest first."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(40 - length)
    fill, seen = collections.Counter(), collections.Counter()
    for m in packing.supersteps(counts, 40):
        for r in range(m.lo, m.hi):
            fill[m.base + (r - m.lo) // m.per] += m.length
            seen[m.length] += 1
    assert seen == collections.Counter(counts)
    assert sorted(40 - v for v in fill.values()) == sorted(gaps)


def test_special_tokens_as_the_tokenizer_gives_them(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["ab <|endoftext|> cd", "<|endoftext|>", "汉 <|endoftext|>\u2003x", "<|endoftext |>", "plain"]
    rows = {r.doc_id: r for r in packing.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert rows[i].length == len(ids) and rows[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoders_agree():
    pytest.importorskip("public_tokenizers")
    e = packing.Encoder(packing.public_vocabulary())
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(32, 127), 10, 9, *range(0xA1, 0x180), 0x2014, 0x2019]]
    for _ in range(800):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else [" ", "a", "1", "'", "\n"]) for _ in range(rng.randint(0, 30)))
        assert e._plain.match(text) and e.fast.encode_ordinary(text) == e.whole.encode(text, add_special_tokens=False).ids


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    n, m = 7, 3
    scores, moves, start = rng.normal(size=(2 * n, m)), rng.normal(size=(m, m)), rng.normal(size=m)
    fresh = np.zeros(2 * n, bool)
    fresh[[0, n]] = True
    for block in (1, 3, 5, 64):
        got, pairs = language_crf.forward_backward(scores, fresh, moves, start, block)
        joint = np.zeros((m, m))
        for at in (0, n):
            part, z = np.zeros((n, m)), 0.0
            own = np.zeros((m, m))
            for y in itertools.product(range(m), repeat=n):
                w = np.exp(start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)))
                z += w
                for i in range(n):
                    part[i, y[i]] += w
                for i in range(1, n):
                    own[y[i - 1], y[i]] += w
            assert np.allclose(got[at : at + n], part / z)
            joint += own / z
        assert np.allclose(pairs, joint)


def test_language_query(spark, data):
    out = language_crf.digest(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_code_switched_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang in ('en', 'fr')").select("text", "lang").collect()
    model = language_crf.train([(r.text, r.lang) for r in docs[:-20]])
    by = collections.defaultdict(list)
    for r in docs[-20:]:
        by[r.lang] += r.text.split()
    text = " ".join(by["en"][:40] + by["fr"][:40] + by["en"][40:80])
    _, marginal, _ = next(language_crf.label_texts(model, [text]))
    want = ["en"] * len(by["en"][:40]) + ["fr"] * len(by["fr"][:40]) + ["en"] * len(by["en"][40:80])
    assert np.mean([model.labels[k] == w for k, w in zip(marginal.argmax(axis=1), want, strict=True)]) > 0.9


def test_numerals_are_no_letters(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(["²", "½ ½", "Ⅷ", "12 _", "汉"])], docs.schema)
    got = {r.doc_id: r.lang_pred for r in language_crf.digest(docs.union(odd)).where("doc_id >= 1000000").collect()}
    assert [got[10**6 + i] for i in range(4)] == ["und"] * 4 and got[10**6 + 4] != "und"


def test_language_query_against_plain_python(spark, data):
    """One text at a time, one word at a time, over all documents."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    learned = [(r.text, r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    rows = spark.createDataFrame(learned, "text string, lang string")
    drawn = language_crf.sample(rows)
    assert drawn == language_crf.sample(rows.union(rows.orderBy(F.col("text").desc())))
    assert set(drawn) <= set(learned) and len(drawn) == sum(min(120, len({t for t, x in learned if x == lang and t is not None})) for lang in {x for _, x in learned if x})
    m = language_crf.train(drawn)
    place = {int(h): k for k, h in enumerate(m.lexicon)}
    some = docs.where("doc_id % 9 = 0").collect()
    got = {r.doc_id: r for r in language_crf.predict(docs.where("doc_id % 9 = 0"), m, ["doc_id"]).collect()}
    step, first = np.exp(m.transitions), np.exp(m.start) / np.exp(m.start).sum()
    for r in some:
        words = language_crf.lowered(r.text).split()
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        hashes = shingles.word_hashes([b" ".join(words)])[0]
        e = []
        for w, h in zip(words, hashes, strict=True):
            buckets, _ = language_crf.spelled([w])
            score = m.grams[buckets].sum(axis=0) + (m.words[place[int(h)]] if int(h) in place else 0)
            e.append(np.exp(score - score.max()))
        a, b = [first * e[0] / (first * e[0]).sum()], [np.ones(len(m.labels))]
        for x in e[1:]:
            v = (a[-1] @ step) * x
            a.append(v / v.sum())
        for x in e[:0:-1]:
            v = step @ (x * b[-1])
            b.append(v / v.sum())
        share = np.mean([v / v.sum() for v in (x * y for x, y in zip(a, b[::-1], strict=True))], axis=0)
        assert got[r.doc_id].lang_pred == m.labels[int(share.argmax())] and got[r.doc_id].score == pytest.approx(share.max(), abs=1e-6)
    runs = collections.defaultdict(list)
    for r in language_crf.word_runs(docs.where("doc_id % 9 = 0"), m).collect():
        runs[r.doc_id].append((r.start, r.end))
    for r in some:
        n = len(WORD.findall(r.text or ""))
        spans = sorted(runs[r.doc_id])
        assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]][: len(spans)] and (spans[-1][1] if spans else 0) == n


def test_language_edges(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.digest(edge_docs(spark)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6][0] in ("en", "de", "fr") and len(got) == 12
    assert language_crf.digest(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_crf.digest(unlabelled).collect()} == {"und"}


def test_prose_is_long_enough():
    assert len(PROSE.split()) > passages.MIN_RUN
