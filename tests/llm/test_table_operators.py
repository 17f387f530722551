"""Jaccard join, URL filters, mixing, chat formatting, neighbours, packing, pipeline."""

import hashlib
import math
import os
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from promptledger.llm import (alignment, chat, components, hosts, jaccard, mixing, neighbours, packing, phrases, quality, queries, secrets,
                              shingles, toxicity)

from .helpers import LONG, PROSE, documents, lowered, tokens


# ---------------------------------------------------------------- n-gram Jaccard join
def slow_groups(rows):
    sets = {}
    for d, t in rows:
        w = tokens(lowered(t))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, n=160):
    """Families of edited copies, chains whose ends do not link, a passage in a third of all texts."""
    rng = np.random.default_rng(seed)
    word = lambda: f"t{rng.integers(4000)}"
    passage = [word() for _ in range(25)]
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or len(out) < 4:
            w = [word() for _ in range(int(rng.integers(1, 90)))]
        else:
            w = tokens(out[int(rng.integers(len(out)))] if kind == 1 else out[-1])
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = word()
        if rng.random() < 0.3:
            w += passage
        out.append(" ".join(w).upper() if rng.random() < 0.1 else "\n".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("seed,node", [(1, 256), (2, 3)])
def test_groups_as_by_brute_force(spark, seed, node, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE", node)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(spark, rows)).collect()}
    assert got == slow_groups(rows)


def test_members_go_on_by_size(spark):
    """Of a tile only texts with another of three quarters to four thirds of their size are sent to its cells."""
    sizes = {1: 100, 2: 133, 3: 200, 4: 1000, 5: 1334, 6: 30}
    shared = spark.createDataFrame([(7, sig, (n << 32) + n) for sig, n in sizes.items()], "tile long, a long, b long")
    members = jaccard._members(shared)
    assert sorted(map(tuple, members.collect())) == [(7, sig, n, n) for sig, n in sizes.items()]
    flat = jaccard.point(np.arange(100, dtype=np.uint64))
    points = spark.createDataFrame([(sig, flat) for sig in sizes], "sig long, rough binary")  # without texts 3 to 6 their rows end here
    pairs = jaccard._across(members, spark.createDataFrame([], "v long, label long"), points, False).collect()
    assert {(r.a, r.b) for r in pairs} == {(1, 2)}


def test_exact_border_links():
    # 12 of 16 shingles shared is just enough, 11 of 16 is not: the bound must keep the first.
    a, b = set(range(14)), set(range(2, 16))
    assert 7 * len(a & b) >= 3 * (len(a) + len(b)) and 100 * len(a & b) >= 75 * len(a | b)
    common = np.zeros(jaccard.GROUPS, np.uint8)
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        pool = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        least = math.ceil(0.75 * n)
        left, right = pool[:least] if least else pool, pool
        assert set(jaccard._leading(left, common).tolist()) & set(jaccard._leading(right, common).tolist())


def test_shingles_follow_the_definition(monkeypatch):
    def distinct(text):
        w = tokens(lowered(text))
        return len({tuple(w[i:i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w))

    texts = ["", "a", "a b c d", "a b c d e", "a b c d e a b c d e a", PROSE, LONG, "é  ß\tx\x0by \x85 z q r", "a" * 5000 + " b" * 40]
    sets = [shingles.shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [distinct(t) for t in texts]
    assert len(shingles.shingle_set(None)) == 0
    assert (shingles.shingle_set("Ab c D e F") == shingles.shingle_set("aB\nC d\te f")).all()
    assert shingles.signature(shingles.shingle_set("ab c")) != shingles.signature(shingles.shingle_set("a bc"))
    monkeypatch.setattr(shingles, "SEGMENT_WORDS", 7)
    assert all((shingles.shingle_set(t) == s).all() for t, s in zip(texts, sets))


def test_groups_take_awkward_rows(spark):
    docs = documents(spark)
    got = jaccard.similar_groups(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert of[1] == of[2] == (16, 1) and of[8][1] == 1 and of[3] == (0, 3) and of[4] == (0, 4) and of[5] == (0, 5) and of[7] == (1, 7)
    assert Counter((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == {(16, 1): 1, (0, None): 1}
    assert jaccard.similar_groups(documents(spark, [])).count() == 0
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, None: 2}


def test_texts_under_one_id_are_judged_one_by_one(spark):
    alone = " ".join(f"alone{i}" for i in range(30))
    rows = [(2, PROSE, "b"), (5, alone, "z"), (5, PROSE, "y"), (5, alone.upper(), "x"), (2, PROSE, "a"), (6, "", "q"), (6, None, "p"), (6, PROSE + " today", "c")]
    for seed in range(3):
        docs = documents(spark, [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]).repartition(4)
        kept = sorted((r.doc_id, (r.text or "").lower(), r.source) for r in jaccard.first_of_each(docs).collect())
        assert [x[:2] for x in kept] == [(2, PROSE.lower()), (5, alone), (6, "")] and kept[0][2] == "a"


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.v: r.label for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 101, 102)} == {100}


# ---------------------------------------------------------------- URL filters
def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM", "http://a.example.com/EN/x", "http://a.example.com/en/x?y#z", "x://www.example.com/en/",
            "http://b.www.example.com/en/1", "http://notexample.com/en/", "http://shop.net/es/a", "http://net/fr/", "http://shop.net/de/", "http://u.org?q=/en/",
            "a://b://c/d", "http://com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = pages.selectExpr("url", "cast(null as boolean) as bad")
    got = [(r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, none).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "", None, "allow"),
        ("a.example.com", "/EN/x", "com/", "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("b.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("notexample.com", "/en/", "com/", "allow"), ("shop.net", "/es/a", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"), ("shop.net", "/de/", None, "allow"), ("u.org", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("com", "/", "com/", "allow")]


def test_reputation_shrinks_and_blocks(spark):
    rows = [("http://bad.spam.org/x", True)] * 60 + [("http://new.spam.org/x", True)] * 2 + [("http://fine.good.org/x", False)] * 80 + [("http://one.good.org/", True)] * 2
    seen = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(i, f"http://{h}.org/") for i, h in enumerate(("bad.spam", "new.spam", "fine.good", "one.good", "never.seen"))] * 2, "page_id long, url string")
    got = {r.host: r.verdict for r in hosts.judge(pages, seen).collect()}
    # Two bad pages block a host of a bad domain, not one of a good domain.
    assert got == {"bad.spam.org": "block", "new.spam.org": "block", "fine.good.org": "allow", "one.good.org": "allow", "never.seen.org": "allow"}
    assert hosts.judge(pages.limit(0), seen.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 25), min_size=1, max_size=9))
def test_every_lane_stays_within_one_block(shares):
    plan, total = mixing.edf_template(shares), sum(shares)
    owner = {slot: lane for lane, blocks in enumerate(plan) for slot, _, _ in blocks}
    assert sorted(owner) == list(range(total))
    counts = Counter()
    for slot in range(total):
        counts[owner[slot]] += 1
        assert all(abs(mixing.lag(counts[i], slot + 1, a, total)) < 1 for i, a in enumerate(shares))
    assert all(r <= s < d for blocks in plan for s, r, d in blocks)


def test_mixture_follows_the_schedule(spark):
    rows = [(i, "x" * (50 + i % 7 * 30), ("big", "small", "odd", None)[(i % 10 > 5) + (i % 10 > 7) + (i % 10 > 8)]) for i in range(3000)]
    shares = {"big": 2, "small": 5, "*": 1}
    got = mixing.mix(documents(spark, rows), shares, block_chars=1000, cell_rows=64).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    lanes = defaultdict(list)
    for r in got:
        lanes[r.mix_lane].append(r)
    plan = dict(zip(("*", "big", "small"), mixing.edf_template([1, 2, 5])))
    assert set(lanes) == {"*", "big", "small"} and {r.source for r in lanes["*"]} == {"odd", None}
    for name, mine in lanes.items():
        mine.sort(key=lambda r: r.mix_at)
        ends = 0
        for r in mine:
            assert r.mix_at == ends and r.mix_block == r.mix_at // 1000
            ends += len(r.text)
            n, j = divmod(r.mix_block, len(plan[name]))
            assert (r.mix_slot, r.mix_release, r.mix_deadline) == tuple(8 * n + x for x in plan[name][j])


def test_mixing_takes_awkward_rows(spark):
    docs = documents(spark)
    got = mixing.mix(docs, {"src1": 3}, cell_rows=2)
    assert got.count() == docs.count() and got.columns[:len(docs.columns)] == docs.columns
    again = mixing.mix(got, {"src1": 3}, cell_rows=2)
    assert again.columns == got.columns and sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert mixing.mix(documents(spark, []), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src1": 0})


# ---------------------------------------------------------------- chat formatting
TEXTS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "<\\|", "a", " ", "\n", "assistant", "é𝄞", "<|newline|>"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_turns_come_back(role, text):
    t = chat.template(chat.VOCABULARY)
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    ids, runs = t.turn(role, text)
    assert t.read(ids) == (role, text) and ids.count(t.start) == ids.count(t.end) == 1
    assert t.loss_text(ids, runs) == (text if role == "assistant" else "")
    assert t.render(ids).count(chat.START) == 1


def test_long_turns_are_cut_without_loss():
    t = chat.template(chat.VOCABULARY)
    for text in (LONG, "x" * 100_000, "\n" * 70_000):
        assert t.coder.decode(t.encode(text)) == text


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same"),
            (4, 0, "assistant", LONG)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids", "2 as ord")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(talks)).collect()}

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, digest("user\na\nassistant\nb\nassistant\n\n"), 1, digest("b"))
    assert got[2].turns_sha256 == digest("\n\n") and got[2].loss_sha256 == digest("") and got[3].n_turns == 2 and got[None].n_turns == 1
    assert got[4].loss_chars == len(LONG) and got[2].formatted_chars == len("<|im_start|>\n<|im_end|>\n")
    assert chat.digests(chat.format_turns(talks.limit(0))).count() == 0
    places = chat.token_places(chat.format_turns(talks)).where("conv_id = 1").orderBy("turn").collect()
    assert [r.first_id for r in places] == [0, len(places[0].ids), len(places[0].ids) + len(places[1].ids)]


# ---------------------------------------------------------------- neighbours
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as dim", "2 as v", "3 as chunk")


def slow_nearest(rows, q, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    mine = next((v for i, v in ok if i == q), None)
    if mine is None:
        return []
    return sorted((float(np.sqrt(((v - mine) ** 2).sum())), i) for i, v in ok if i != q and len(v) == len(mine))[:k]


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (200, None), (201, [0.0] * 6), (202, [1.0, None] + [0.0] * 4), (203, [math.nan] + [1.0] * 5),
             (204, [math.inf] + [1.0] * 5), (300, [1.0, 2.0]), (None, [1.0] * 6), (301, [])]
    df = vectors(spark, rows)
    got = defaultdict(list)
    for r in neighbours.search(df, df, chunk_rows=9, query_rows=7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in {i for i, _ in rows} - {None}:
        want = [(n + 1, i, d) for n, (d, i) in enumerate(slow_nearest(rows, q, 10))]
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in want], rtol=1e-12)
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_with_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x[1000:2500] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = vectors(spark, rows)
    got = defaultdict(set)
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), chunk_rows=1500).collect():
        got[r.query_id].add(r.vec_id)
    hit = [len(got[q] & {i for _, i in slow_nearest(rows, q, 10)}) for q in range(0, 4000, 100)]
    assert sum(hit) >= 0.9 * 10 * len(hit) and got[1000] == {7} | set(range(1001, 1010))


# ---------------------------------------------------------------- packing
def slow_best_fit(items, capacity, per_source):
    bins, out = [], {}
    for n in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[n]
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)
                if sum(x[0] for x in b) + size <= capacity and all(x[2] != cluster for x in b) and sum(x[1] == source for x in b) < per_source]
        if not fits:
            bins.append([])
            fits = [(capacity, len(bins) - 1)]
        b = min(fits)[1]
        out[n] = (b, sum(x[0] for x in bins[b]))
        bins[b].append(items[n])
    return [out[i] for i in range(len(items))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 12)), max_size=60), st.integers(1, 3))
def test_tightest_compatible_bin(items, per_source):
    assert packing.best_fit(items, 20, per_source) == slow_best_fit(items, 20, per_source)


def test_every_word_is_packed_once(spark):
    docs = documents(spark, [(i, " ".join(["w"] * (i * 7 % 90)) + f" {i % 40}", f"s{i % 3}") for i in range(300)] + [(999, LONG), (None, None), (998, ""), (998, "")])
    got = packing.pack(docs, capacity=100, per_source=2, shard_rows=64).collect()
    words, bins = Counter(), defaultdict(list)
    for r in got:
        words[r.doc_id] += r.n_words
        bins[r.bin].append(r)
    assert words == Counter({d.doc_id: 0 for d in docs.collect()}) + words and words[999] == 30_000 and words[None] == 0
    assert {k: v for k, v in words.items() if k is not None and k < 900} == {i: i * 7 % 90 + 1 for i in range(300)}
    source = {d.doc_id: d.source for d in docs.collect()}
    for mine in bins.values():
        mine.sort(key=lambda r: r.bin_offset)
        assert mine[0].bin_offset == 0 and all(a.bin_offset + a.n_words + 1 == b.bin_offset for a, b in zip(mine, mine[1:]))
        assert mine[-1].bin_offset + mine[-1].n_words <= 100 and max(Counter(source[r.doc_id] for r in mine).values()) <= 2
    assert packing.pack(documents(spark, [])).count() == 0


def test_near_copies_with_a_cluster_go_to_different_bins(spark):
    rows = [(i, f"{PROSE} {i}", f"s{i}") for i in range(12)] + [(i, PROSE.upper() if i % 2 else PROSE, f"s{i}") for i in range(12, 16)]
    docs = documents(spark, rows).selectExpr("*", "if(doc_id < 12, 'c' || doc_id % 2, null) as grp")
    bins = defaultdict(list)
    for r in packing.pack(docs, cluster="grp").collect():
        bins[r.bin].append(r.doc_id)
    clusters = {b: [i % 2 if i < 12 else "text" for i in ids] for b, ids in bins.items()}
    assert sum(map(len, bins.values())) == 16 and all(len(set(c)) == len(c) for c in clusters.values()) and len(bins) == 6
    assert len({r.bin for r in packing.pack(docs.where("doc_id < 12")).collect()}) == 1


# ---------------------------------------------------------------- pipeline and registered queries
def test_bins_follow_the_mixture(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(packing, "SHARD_ROWS", 256)
    monkeypatch.setitem(packing.pack.__kwdefaults__, "shard_rows", 256)
    rows = [(i, "word " * (10 + i % 7 * 6), f"src{i % 8}" if i % 3 else "src0") for i in range(12_000)]
    docs = {i: (len(t), s if s in queries.SHARES else "*") for i, t, s in rows}
    stages = dict(corpus_pipeline.STAGES)
    plain, ordered = str(tmp_path / "plain"), str(tmp_path / "ordered")
    documents(spark, rows).write.parquet(plain)
    stages["mixing"](spark, spark.read.parquet(plain), "").write.parquet(ordered)

    def bins(path):
        return stages["packing"](spark, spark.read.parquet(path), "").collect()

    got = bins(ordered)
    assert sorted(r.doc_id for r in got if r.piece == 0) == sorted(docs) and len(_by(got, "bin_run", "bin")) > 5
    assert all(len(b) == 1 for b in _by(got, "bin", "bin_run").values())
    runs = defaultdict(set)
    for r in got:
        runs[r.bin_file, r.bin_run].add(r.doc_id)
    chars, total, checked = Counter(), sum(queries.SHARES.values()), 0
    whole = Counter()
    for n, s in docs.values():
        whole[s] += n
    for _, mine in sorted(runs.items()):
        for i in mine:
            chars[docs[i][1]] += docs[i][0]
        if any(chars[lane] == whole[lane] for lane in queries.SHARES):
            break  # from here on a lane is used up
        for lane, share in queries.SHARES.items():
            assert abs(chars[lane] - share / total * sum(chars.values())) < 2 * 2000 + 260
            checked += 1
    assert checked > 30
    # Without the stage the bins are others.
    groups = [sorted(sorted(x) for x in _by(g, "bin", "doc_id").values()) for g in (got, bins(plain))]
    assert groups[0] != groups[1]
    from_memory = stages["packing"](spark, documents(spark, rows[:100]), "")
    assert sorted(r.doc_id for r in from_memory.collect()) == list(range(100))


def test_many_copies_are_packed_fast():
    began = time.perf_counter()
    out = packing.best_fit([(100, 1, 7)] * 8000, 4096, 4)
    assert len({b for b, _ in out}) == 8000 and time.perf_counter() - began < 3


def test_repeated_rows_are_dealt_to_all_shards(spark):
    docs = spark.range(2000).selectExpr("7L as doc_id", "'src' as source", "'the same text' as text").repartition(4)
    shards = Counter(r.bin.split("-")[0] for r in packing.pack(docs, shard_rows=100).collect())
    assert len(shards) == 20 and max(shards.values()) < 200


def test_columns_with_internal_names(spark):
    """Extra columns of any name change nothing, and stages keep them."""
    rows = [(i % 40, f"{PROSE} {i % 7} {'bad worse' if i % 5 else 'kind'} " * 8, f"src{i % 3}") for i in range(120)]
    names = ["row", "p", "size", "pack_size", "pack_cluster", "cluster", "lane", "ord", "nth", "cell", "cells", "_mix_lane", "_mix_size", "_tox_text",
             "tox_p", "file", "place", "run", "shard", "h", "y", "b", "hash", "block", "at", "idx", "c", "left", "right", "key", "part", "first", "ids"]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "length(text) as n_chars")
    docs = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    same = lambda f: (sorted(map(str, f(plain).collect())), sorted(map(str, f(docs).collect())))
    for f in (lambda d: toxicity.classify(d, labels), lambda d: packing.pack(d).drop("bin"), lambda d: secrets.scan(d),
              lambda d: quality.classify(d, labels), lambda d: phrases.collocations(d, min_count=3), lambda d: alignment.digests(d),
              lambda d: mixing.mix(d, {"src1": 2}).select("doc_id", "mix_slot", "mix_at")):
        assert len(set(map(tuple, same(f)))) == 1
    for stage in (lambda d: toxicity.clean(d, labels), secrets.redacted, lambda d: mixing.mix(d, {"src1": 2}).drop(
            "mix_lane", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")):
        out = stage(docs)
        assert out.columns == docs.columns and out.select(*names).distinct().count() == 1


def test_labelled_rows_are_bounded(spark):
    """A labelled row counts once, however often it is repeated; a null label leaves out that category only."""
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = spark.range(3000).selectExpr("1L as doc_id", "'awful words' as text").union(spark.sql("select 2L, 'nice words'")).union(spark.sql("select 3L, 'x'"))
    seen = []
    whole = toxicity.fit_chain
    try:
        toxicity.fit_chain = lambda buckets, y, folds, limits: seen.append((len(buckets), np.isnan(y).sum())) or whole(buckets, y, folds, limits)
        toxicity.train(rows, labels)
        toxicity.train(rows, labels, max_labelled=1)
    finally:
        toxicity.fit_chain = whole
    assert seen[0] == (3, 1) and seen[1][0] == 1


def test_quality_model_does_not_depend_on_order(spark):
    rows = [(i % 30, "word " * (i % 50 + 1) + "." * (i % 3)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    models = [quality.fit(quality.text_statistics(spark.createDataFrame(r, "doc_id long, text string").repartition(n)), labels).beta
              for r, n in ((rows, 1), (rows[::-1], 3))]
    assert (models[0] == models[1]).all()


def _by(rows, key, value):
    out = defaultdict(set)
    for r in rows:
        out[r[key]].add(r[value])
    return out


def test_pipeline_stages_take_effect(spark, tmp_path):
    import shutil

    for t in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.01/{t}.parquet", tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    read = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(5)]
    n = [r.count() for r in read]
    assert before > n[0] > n[1] == n[2] == n[3]
    assert {r.doc_id for r in read[4].select("doc_id").collect()} == {r.doc_id for r in read[3].select("doc_id").collect()}
    groups = jaccard.similar_groups(read[0])
    assert n[1] == groups.select("component_id").distinct().count()
    assert read[2].where("text rlike '(?i)token = \"[0-9a-f]{24}'").count() == 0 < read[1].where("text rlike '(?i)token = \"[0-9a-f]{24}'").count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == \
        sorted(r.doc_id for r in read[4].select("doc_id").distinct().collect())


def test_stages_take_awkward_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents(spark), documents(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[0] == "doc_id" and docs.where("piece = 0").count() in (0, 9)


def test_every_operator_is_registered():
    names = {q.split("_")[0] for q in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.ORACLES) == {"op3_url_filter", "op6_chat_format", "op11_collocations"} and corpus_pipeline.ORACLE_SQL is None
    assert os.path.exists(chat.VOCABULARY)
