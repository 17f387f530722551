"""Phrase collocations, token files and cross-tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from promptledger.llm import alignment, phrases, pretokens, token_files

from .helpers import LONG, PROSE, documents

ODD = ["a", "word", "The", " ", "  ", "\n", "\t", "é", "\xa0", "　", "᠎", "​", " ", "1", "٣", "'s", "'", ".", ",", "漢", "🙂", "▁",
       "\x00", "\x85", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "é", "﻿", "\r", "\x1f", "..."]
TEXTS = st.lists(st.sampled_from(ODD), max_size=14).map("".join)
ROWS = [(5, PROSE), (3, None), (4, ""), (6, LONG), (2, PROSE), (2, PROSE), (None, "no id"), (None, None), (9, "ünï çödé ß " * 40), (7, " \n\t "),
        (8, "holds ▁ a mark"), (10, "<|endoftext|> and <s>"), (11, "one"), (2, "another text of two")]


# ---------------------------------------------------------------- collocations
def slow_collocations(rows, min_count, longest, top, percent):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = []
    several = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    for (lang, p), a in several.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(o[0] == lang and len(o[1]) > len(p) and 100 * b >= percent * a and
                     any(o[1][i:i + len(p)] == p for i in range(len(o[1]))) for o, b in several.items())
        if not inside:
            found.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, i + 1, p, a, left, r, m, s) for i, (_, s, a, p, left, r, m) in enumerate(mine)]
    return sorted(out)


def lang_table(spark, rows):
    return spark.createDataFrame([(x[0], x[1], 1, "z", 2) for x in rows], "lang string, text string, f long, words string, id int")


@pytest.mark.parametrize("percent", [100, 60])
def test_collocations(spark, monkeypatch, percent):
    rng = random.Random(percent)
    vocabulary = ["a", "b", "c", "É", "d\xa0e", "F", "\x00", "g"]
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " "]
    rows = [(rng.choice(["x", "y", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(signs) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("x", "a B c a b c a b"), ("x", None), ("y", ""), (None, None), ("z", "same same same " * 40)] + [("x", "hot pair")] * 30
    # Several small blocks, so groups meet only in the shuffle.
    monkeypatch.setattr(phrases, "BLOCK", 150)
    monkeypatch.setattr(phrases, "HELD", 400)
    monkeypatch.setattr(phrases, "RANGE", 200)
    got = phrases.collocations(lang_table(spark, rows).repartition(3), min_count=4, top=25, absorbed_percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, 4, 5, 25, percent)


def test_collocations_without_words(spark):
    for rows in ([], [("x", None), (None, ""), ("x", " \n. ")], [("x", "once only")]):
        assert phrases.collocations(lang_table(spark, rows)).collect() == []


def test_long_counts_stay_exact(spark):
    x = spark.sql("select cast(9e12 as decimal(20,0)) a, cast(9e12 as decimal(20,0)) n, cast(9e12 as decimal(20,0)) l, cast(3 as decimal(20,0)) r")
    assert x.selectExpr("cast((1000 * a * n) div (l * r) as bigint) s").first().s == 1000 * int(9e12) * int(9e12) // (int(9e12) * 3)


# ---------------------------------------------------------------- chunks
@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_chunks_encode_like_whole_texts(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path) if not CODERS else CODERS[0]
    CODERS.append(whole)
    assert np.frombuffer(token_files.encode(text, path), np.int32).tolist() == whole.encode(text, add_special_tokens=False).ids


CODERS = []


def test_stretches(monkeypatch):
    monkeypatch.setattr(pretokens, "STRETCH", 50)
    for text in ("", "x", LONG[:5000], " " * 300, "a\n" * 200, " a  b" * 60, "é \x85x y\xa0 z" * 20, "漢 a b\n c"):
        assert " ".join(c for chunks in pretokens.stretches(text) for c in chunks) == text


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_quick_cuts_are_cuts(text):
    assert pretokens._cut(text) == pretokens._CUT.split(text)


def test_memory_forgets():
    asked = []
    memory = pretokens.Memory(lambda new: [asked.append(c) or c.upper() for c in new], 3)
    for i in range(40):
        assert memory.of(["hot", f"c{i}", f"d{i}", "hot"]) == ["HOT", f"C{i}", f"D{i}", "HOT"]
        assert len(memory.now) <= 6
    assert asked.count("hot") == 1 and len(asked) == 81


# ---------------------------------------------------------------- token files
def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_IDS", 100)
    path = str(tmp_path / "ids")
    docs = documents(spark, ROWS).repartition(3)
    token_files.write_token_ids(docs, path, index_rows=1000)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc, text in ROWS:
        want.setdefault(doc, []).append(coder.encode(text or "", add_special_tokens=False).ids + [0])
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        ids = next(i for i in want[r.doc_id] if zlib.crc32(np.array(i, "<u4").tobytes()) == r.ids_crc32 and len(i) == r.n_tokens)
        want[r.doc_id].remove(ids)
        assert r.start == at
        at += r.n_tokens
    assert not any(want.values())
    order = [(r.doc_id is not None, r.doc_id) for r in got]
    assert order == sorted(order)
    rows = token_files.read_token_ids(spark, path, [6, 11]).collect()
    assert {r.doc_id: r.ids for r in rows} == {6: coder.encode(LONG, add_special_tokens=False).ids + [0], 11: coder.encode("one", add_special_tokens=False).ids + [0]}
    assert {r.doc_id: r.start for r in rows} == {r.doc_id: r.start for r in got if r.doc_id in (6, 11)}
    scan = token_files.read_token_ids(spark, path, [6])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in scan and "EqualTo(doc_id,6)" in scan


def test_stripes_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "many")
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 300), x -> hash(id, x))) as text").repartition(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write_token_ids(docs, path, stripe_bytes=1 << 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = sorted(Path(path).glob("*.orc"))
    assert sum(pyarrow.orc.ORCFile(f).nstripes for f in files) > len(files)  # several tasks can read a file
    # Only Bloom filters and indexes can tell that an id between the least and the greatest is not there.
    assert token_files.read_token_ids(spark, path, [1234]).count() == 1
    assert token_files.digests(spark, path).selectExpr("sum(n_tokens) s", "max(start + n_tokens) m").first()[:] == \
        (spark.read.orc(path).selectExpr("sum(size(ids))").first()[0],) * 2
    token_files.write_token_ids(docs.limit(0), str(tmp_path / "none"))
    assert token_files.digests(spark, str(tmp_path / "none")).collect() == []


# ---------------------------------------------------------------- alignment
@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def slow_tokens(coders, text):
    """(id, bytes) of both vocabularies, or nothing."""
    a, b = coders
    if not text:
        return [], []
    letters = alignment.byte_alphabet()
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) and b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == want == b"".join(x for _, x in two) else ([], [])


def slow_ranges(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def slow_digests(coders, rows):
    texts = [tuple(slow_ranges(t) for t in slow_tokens(coders, text)) for _, text in rows]
    linked = [[(x[0], y[0]) for x in a for y in b if x[2] == y[2]] for a, b in texts]
    count = Counter(p for links in linked for p in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (doc, _), (a, b), links in zip(rows, texts, linked):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(y[0]) for y in b if lo < y[2] <= hi)
                  for lo, hi in zip([0, *ends], ends)]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sha))
    return out


SHORT = [(d, t if t != LONG else LONG[:3000]) for d, t in ROWS]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_digests(spark, coders, broadcast_pairs):
    rng = random.Random(3)
    rows = SHORT + [(100 + i, "".join(rng.choice(ODD) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = alignment.digests(documents(spark, rows).repartition(3), broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow_digests(coders, rows), key=key)


def test_alignment_of_empty_tables(spark):
    assert alignment.digests(documents(spark, ROWS).limit(0)).collect() == []
    nothing = alignment.digests(documents(spark, [(1, None), (2, "")])).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("kind", alignment.KINDS)
def test_links(spark, coders, kind, monkeypatch):
    monkeypatch.setattr(alignment, "TERMS", 64)  # several blocks of rows
    rows = SHORT
    got = alignment.align(documents(spark, rows), kind=kind).collect()
    for r, (doc, text) in zip(got, rows):
        a, b = (slow_ranges(t) for t in slow_tokens(coders, text))
        assert (r.doc_id, r.a_ids, r.b_ids) == (doc, [x[0] for x in a], [y[0] for y in b])
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        group = lambda end: next(i for i, e in enumerate(ends) if end <= e)
        same = {"overlap": lambda x, y: x[1] < y[2] and y[1] < x[2], "end": lambda x, y: x[2] == y[2],
                "group": lambda x, y: group(x[2]) == group(y[2])}[kind]
        near = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x[1] - y[1]) < 200 and same(x, y)]
        assert sorted((p.a, p.b) for p in r.links) == near


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(1, 7), st.randoms())
def test_sparse_products(n, k, m, rng):
    x, y = (np.array([[rng.choice([0, 0, 1]) for _ in range(c)] for _ in range(r)]) for r, c in ((n, k), (k, m)))

    def sparse(d):
        return alignment.csr(np.concatenate([[0], np.cumsum((d > 0).sum(axis=1))]), np.nonzero(d)[1], d.shape[1])

    def dense(s):
        out = np.zeros((len(s.starts) - 1, s.width), int)
        out[s.rows(), s.columns] = s.values
        return out

    assert (dense(alignment.product(sparse(x), sparse(y))) == x @ y).all()
    assert (dense(alignment.transposed(sparse(x))) == x.T).all()


def test_vocabularies_bound_the_pairs(spark, sf):
    a = alignment.Aligner(*alignment._paths(None, None), "end")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = alignment.pair_counts(docs).collect()
    assert 0 < len(pairs) <= a.most_pairs() <= alignment.BROADCAST_PAIRS
    for p in pairs:
        x, y = a.bytes_a[p.a_id], a.bytes_b[p.b_id]
        assert x.endswith(y) or y.endswith(x)
