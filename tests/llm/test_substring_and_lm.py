from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triplewright.llm import lm, queries, substring
from triplewright.llm.automaton import SuffixAutomaton
from triplewright.llm.gru import END, Gru, lanes

words = st.lists(st.sampled_from("abc"), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=4), words)
def test_matching_statistics(passages, text):
    a = SuffixAutomaton(passages)
    runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    for i, n in enumerate(a.statistics(text)):
        want = max((k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in runs), default=0)
        assert n == want
    for least in (1, 2, 3):
        covered = {i for s, e in a.spans(text, least) for i in range(s, e)}
        want = {i for s in range(len(text) - least + 1) for i in range(s, s + least) if tuple(text[s : s + least]) in runs}
        assert covered == want


def removed(rows, window):
    first: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(4)]
    rows = []
    for i in range(60):
        own = " ".join(f"o{v}" for v in rng.integers(0, 5000, 30))
        p = passages[int(rng.integers(4))].split()
        a, b = sorted(rng.integers(0, 41, 2).tolist())
        rows.append((100 - i, f"{own}\n{' '.join(p[a:b])} \t{own if i % 7 == 0 else ''} tail{i} {' '.join(passages[i % 4].split()[:15])}"))
    rows += [(200, rows[0][1]), (201, rows[0][1].replace(" ", "\n")), (3, None), (4, ""), (5, "short text"), (None, passages[0]), (50, passages[1]), (50, passages[1])]
    rows += [(300, "same " * 40), (301, "same " * 20), (302, " ".join(f"z{i}" for i in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "shared": F.lit(2), "body": F.lit(3)})
    rows += [(400 + i, f"{passages[i % 2]} {i}") for i in range(1200)]  # enough for anchors to count as hot
    docs = docs.union(spark.createDataFrame(rows[-1200:], "doc_id long, text string").withColumns({c: F.lit(4) for c in ("h", "shared", "body")}))
    # key_bits=1 lets most first keys collide; the second 64 bits tell windows apart
    for shard, group, bits in ((100_000, 500_000, 64), (50, 60, 1)):
        got = substring.substring_dedup(docs, 13, 7, shard_words=shard, group_words=group, key_bits=bits)
        mine = sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()], key=str)
        assert mine == removed(rows, 13)
    assert substring.substring_dedup(docs.limit(0)).count() == 0
    assert hashlib.sha256(got.where("doc_id = 5").first()["kept"].encode()).hexdigest() == got.where("doc_id = 5").first()["kept_sha256"]


def test_registered_substring_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op9_substring(spark, data).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == removed(rows, 13)


# ---- language model


def plain(g: Gru, docs: list) -> list[float]:
    """Log-likelihoods token by token, gates and softmax written out."""
    p, n, out = {k: v.astype(np.float64) for k, v in g.p.items()}, g.hidden, []
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for doc in docs:
        h, x, total = np.zeros(n), END, 0.0
        for y in doc:
            a, u = p["input"][x], h @ p["state"]
            z, r = 1 / (1 + np.exp(-(a[:n] + u[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + u[n : 2 * n])))
            c = np.tanh(a[2 * n :] + r * u[2 * n :])
            h = (1 - z) * c + z * h
            k, w = divmod(int(y), g.per_class)
            whole = np.concatenate([softmax(h @ p["class_w"] + p["class_b"])[i] * softmax(p["word_w"][i] @ h + p["word_b"][i]) for i in range(len(p["class_b"]))])
            assert abs(whole.sum() - 1) < 1e-9
            total += np.log(whole[k * g.per_class + w])
            x = y
        out.append(total)
    return out


def documents_of(rng, sizes):
    return [np.append(rng.integers(1, 20, n - 1), END) for n in sizes]


def test_lanes_hold_every_document_in_its_order():
    docs = documents_of(np.random.default_rng(3), (5, 1, 17, 3, 40, 2, 9, 8))
    for streams, steps in ((1, 4), (3, 4), (20, 7), (2, 100)):
        seen: dict = {}
        done: list = []
        for y, k, _, ended in lanes(docs, streams, steps):
            for lane in range(y.shape[1]):
                for t, number in zip(y[:, lane].tolist(), k[:, lane].tolist(), strict=True):
                    if number >= 0:
                        assert number not in done
                        seen.setdefault(number, []).append(t)
            done += ended
        assert sorted(done) == list(range(len(docs))) and [seen[i] for i in range(len(docs))] == [d.tolist() for d in docs]


def test_gradients():
    rng = np.random.default_rng(0)
    g = Gru(np.arange(20, 0, -1), 5, 4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    y = rng.integers(1, 20, (6, 3))
    y[4:, 2], y[2, 1] = -1, END  # a lane that runs out, and one with the end of a document inside

    def loss():
        total = 0.0
        for lane in y.T:
            at = [i + 1 for i, t in enumerate(lane) if t == END]
            total -= sum(plain(g, [d[d >= 0] for d in np.split(lane, at)]))
        return total / (y >= 0).sum()

    grads, _, _ = g._window(y, np.zeros((5, 3)), np.full(3, END))
    for k in g.p:
        at = (int(y[1, 0]), 2) if k == "input" else tuple(int(rng.integers(0, s)) for s in g.p[k].shape)
        old = g.p[k][at]
        g.p[k][at] = old + 1e-5
        high = loss()
        g.p[k][at] = old - 1e-5
        low = loss()
        g.p[k][at] = old
        assert abs((high - low) / 2e-5 - grads[k][at]) < 1e-6


def test_state_goes_through_the_whole_document():
    g = Gru(np.arange(20, 0, -1), 6, 5)
    docs = documents_of(np.random.default_rng(1), (70, 1, 33, 2, 70))
    g.train(docs * 3, 8, 4)
    want = plain(g, docs)
    for window, streams in ((100, 8), (7, 2), (32, 1)):
        got = dict(g.score(docs, window, streams))
        assert np.allclose([got[i] for i in range(len(docs))], want, atol=1e-3)
    again = Gru(np.arange(20, 0, -1), 6, 5, seed=99).load(g.dump())
    assert dict(again.score(docs)) == dict(g.score(docs))


def test_scores(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("ab ba cd dc".split()[int(v)] for v in rng.integers(0, 4, 30)) + f" rare{i}" for i in range(60)]
    texts = [" ".join(f"x y z w{i % 3}" for _ in range(20)) + t for i, t in enumerate(texts)]
    rows = [*enumerate(texts), (90, None), (91, ""), (92, "UNSEEN Word"), (None, "x y"), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "known": F.lit(2), "n": F.lit(3)})
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c: Counter = Counter()
    ends = 0
    for i, t in rows:
        if not out(i):
            c.update((t or "").encode().lower().split())
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + 1
    for settings_ in (lm.Settings(dictionary=4, tokens=5, per_class=2, hidden=4, streams=3), lm.Settings(per_class=4, tokens=16, hidden=8, rounds=3, streams=8)):
        got = lm.score_documents(docs, settings_).collect()
        assert len(got) == len(rows)
        by_id: dict = {}
        for i, t in rows:
            w = (t or "").encode().lower().split()
            base = sum(np.log10((c[x] + 1) / (total + distinct + 1)) for x in w) + np.log10((ends + 1) / (total + distinct + 1))
            by_id[i] = (out(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, base)
        for r in got:
            held, n, known, base = by_id[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
            assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    inside = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in inside) > sum(r["base_score"] for r in inside)
    empty = lm.score_documents(docs.limit(0))
    assert empty.count() == 0
    held = next(i for i in range(100) if out(i))
    alone = lm.score_documents(docs.where(F.col("doc_id") == held)).first()
    assert alone["base_score"] == 0 and alone["n_known"] == 0 and alone["train_tokens"] == 0


def test_registered_lm_query(spark, data):
    got = queries.op7_language_model(spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_every_window_of_every_document_is_trained_on():
    texts = [" ".join("abc"[(i * i + n) % 3] for i in range(n)) for n in (0, 3, 16, 40, 700)]
    c = Counter(w for t in texts for w in t.encode().split())
    words = b"\n".join(w for w, _ in c.most_common())
    counts = np.array([n for _, n in c.most_common()])
    shared = SimpleNamespace(value=(words, counts, sum(c.values()) + len(texts), len(c) + 1, len(texts)))
    out = pd.concat(lm._train(shared, None, lm.Settings(together=50))(iter([pd.DataFrame({"text": texts})])))
    assert out["n"].sum() == sum(len(t.split()) + 1 for t in texts)


def test_dictionary_is_full_whatever_the_counts(spark):
    counts = spark.createDataFrame([(f"w{i:02}", 7) for i in range(30)] + [("top", 100)], "word string, n long")
    for most in (1, 10, 31, 50):
        words, n = lm._frequent(counts, most)
        found = words.split(b"\n")
        assert found[0] == b"top" and min(most, 31) - 3 <= len(set(found)) == len(n) <= most


def test_held_out_texts_score_above_the_base(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op7_language_model(spark, folder).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > 0.98 * got["b"]
