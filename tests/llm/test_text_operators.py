"""Secrets, quality rules, quality classifier, toxicity."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from promptledger.llm import quality, rules, secrets, toxicity

from .helpers import LONG, PROSE, documents, tokens

# ---------------------------------------------------------------- secrets
PIECES = st.sampled_from(["password", "PASSWD", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678",
                          "0f3a9c", "deadbeef" * 3, "\n", "é", "𝄞", "x", "/+.", "K", "ſecret"])


def slow_base(text):
    """The definition, one character at a time."""
    spans = []
    at = 0
    pattern = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    while at < len(text):
        m = pattern.match(text, at)
        if m:
            if len(m[2]) >= 6:
                spans.append(("assign", m.start(), m.end()))
            at = m.end()
        else:
            at += 1
    for kind, head, alphabet, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(head)
            while text.startswith(head, at) and end < len(text) and text[end] in alphabet:
                end += 1
            if text.startswith(head, at) and end > at + len(head):
                if end - at >= least:
                    spans.append((kind, at, end))
                at = end
            else:
                at += 1
    order = ("assign", "access", "hex")
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_base_spans_follow_the_definition(text):
    assert [tuple(s) for s in secrets.all_spans(text)[0]] == slow_base(text)


def literals(text):
    return [text[s.start:s.end] for s in secrets.assigned_literals(text)]


def test_assigned_literals():
    assert literals('db_password = "Tr0ub4dor&3x"') == ["Tr0ub4dor&3x"]
    assert literals('a = "Zk3#9qLw0p"\nb = a\nclientSecret = b\n') == ["Zk3#9qLw0p"]
    assert literals('p = "Zk3#9qLw"\nauth_token = p + "77xYv!aa2"\n') == ["Zk3#9qLw", "77xYv!aa2"]
    assert literals("first = private_key = 'qW8$rT5!zz'") == ["qW8$rT5!zz"]
    assert literals("api-key: 9f8e7d6c5b4a3921") == ["9f8e7d6c5b4a3921"]
    assert literals('colour = "Zk3#9qLw0p"; title = "password reset"') == []
    assert literals('password = "changeme"; token: see the manual; secret = ""') == []
    assert literals('x = "unfinished\npassword = y') == []
    chain = 'k0 = "Zk3#9qLw0p"\n' + "".join(f"k{i} = k{i - 1} + k{i - 1}\n" for i in range(1, 3000)) + "password = k2999"
    assert literals(chain) == ["Zk3#9qLw0p"]
    assert secrets.redact('a password="Tr0ub4dor3x" b') == 'a [SECRET]" b'


def test_scan_rows(spark):
    docs = documents(spark, [(1, "token = abcdef 0123456789abcdef01234567"), (None, None), (2, ""), (2, ""), (3, LONG + " AKIA" + "Z" * 16)])
    got = secrets.scan(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and [r.n_assign for r in got if r.doc_id == 1] == [1]
    assert {(r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got if r.doc_id in (None, 2)} == {(0, 0, 0, empty, "")}
    assert [r.n_access for r in got if r.doc_id == 3] == [1]
    one = next(r for r in got if r.doc_id == 1)
    assert one.base_sha256 == hashlib.sha256(b"assign:0:14,hex:15:39").hexdigest()
    assert secrets.scan(documents(spark, [])).count() == 0


def test_redacted_keeps_columns(spark):
    docs = documents(spark, [(1, "x token=abcdef123 y"), (2, None)])
    got = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert got[1].text == "x [SECRET] y" and got[1].n_chars == 12 and got[2].text is None and secrets.redacted(docs).columns == docs.columns


# ---------------------------------------------------------------- quality rules
def slow_counts(text):
    w = tokens(text)
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    runs = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(runs)
    repeated = {j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed)


def test_counts_follow_the_definition(spark):
    rng = np.random.default_rng(3)
    parts = ["a", "bb", "c|", "#", "\n", "  ", "\t", "\x0b", "\r\n", "é", " ", " x"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 120))) for _ in range(60)] + [None, "", "\n\n", "a b c a b c", LONG, (PROSE + "\n") * 4]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:7] for r in rules.quality_rules(docs, docs.where("doc_id < 0")).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}


def test_log_ratio_rejects_what_the_target_does_not_hold(spark):
    rng = np.random.default_rng(4)
    fine = [" ".join(rng.choice(["mill", "river", "bridge", "stone", "old", "sea"], 120)) for _ in range(30)]
    junk = [" ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!"], 40)) + " " + " ".join(f"Z{i}!!" for i in range(80)) for _ in range(10)]
    docs = documents(spark, list(enumerate(fine + junk)))
    got = {r.doc_id: r for r in rules.quality_rules(docs, docs.where("doc_id < 20").select("doc_id")).collect()}
    assert all(got[i].log_ratio > 0 for i in range(30)) and not any(got[i].kept for i in range(30, 40))
    assert len(rules.ngram_ratios(docs, docs.where("doc_id < 20"), buckets=64)) == 64
    none = rules.quality_rules(docs, docs.where("doc_id < 0")).collect()
    assert {r.log_ratio for r in none} == {0.0}


def test_rules_take_awkward_rows(spark):
    docs = documents(spark)
    got = rules.quality_rules(docs, docs.limit(0))
    assert got.count() == docs.count() and got.where("doc_id is null").count() == 2
    assert rules.quality_rules(documents(spark, []), docs).count() == 0


# ---------------------------------------------------------------- quality classifier
def test_isotonic_and_kernel():
    assert quality.pool_adjacent(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [1.0, 2.25, 2.25, 4.0]
    k = quality.Kernel(np.zeros(14), np.ones(14), waves=4000)
    x = np.random.default_rng(1).normal(size=(5, 14))
    z = k(x)[:, :-1]
    want = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08
    assert quality.statistics("").tolist() == [0.0] * quality.N_STATS and np.isfinite(quality.statistics("a\n!")).all()


def test_classifier_on_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_classifier_takes_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, some).collect())
    assert quality.classify(documents(spark, []), some).count() == 0


# ---------------------------------------------------------------- toxicity
def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    of = toxicity.Buckets()
    texts, labels = [], []
    for _ in range(900):
        bad, sour = rng.random() < 0.3, rng.random() < 0.4
        w = [f"v{rng.integers(50)}ab" for _ in range(30)]
        w = [x.replace("v", "vw").replace("1", "q").replace("2", "r") for x in w]
        texts.append(" ".join(w + ["grimble"] * bad + ["sourpuss"] * sour))
        labels.append((sour, bad or sour))
    y = np.array(labels, float)
    chain = toxicity.fit_chain([of(t) for t in texts], y, np.arange(900) % 3)
    p = chain(*toxicity._packed(of(t) for t in texts))
    assert ((p > 0.5) == y).mean() > 0.98 and chain.models[1].dense.shape == (1,)


def test_length_moves_no_score(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.rejected == (r.toxic == 1) for r in got]) > 0.93
    assert np.mean([r.rejected for r in got if r.toxic == 0]) < 0.03


def test_toxicity_takes_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == docs.count() and not any(r.rejected for r in got)
    assert toxicity.clean(docs, none).count() == docs.count() and toxicity.clean(docs, none).columns == docs.columns
    assert toxicity.classify(documents(spark, []), none).count() == 0
