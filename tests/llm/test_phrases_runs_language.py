from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from triplewright.llm import language, phrases, queries, runs
from triplewright.llm.repair import re_pair, runs_of
from triplewright.llm.rolling import Powers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least=10, share=50, most=2000, most_words=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    kept = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = []
    for p, a in kept.items():
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q)))  # noqa: B023, E731
        if any(q[0] == p[0] and inside(q) and 100 * b >= share * a for q, b in kept.items()):
            continue
        cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k, f[p[: k + 1]], f[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    done = []
    for lang, phrase, *rest in out:
        rank[lang] += 1
        if rank[lang] <= most:
            done.append((lang, rank[lang], phrase, *rest))
    return done


def asked(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bits,most_words", [(64, 3), (6, 3), (64, 4)])
def test_collocations_equal_brute_force(spark, bits, most_words):
    rng = np.random.default_rng(3)
    vocab = ["A", "b", "É", "é", "the", "x" * 400, " ", "z z"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(vocab) + str(rng.choice([" ", "  ", "\t", ". ", "\n", " "])) for _ in range(rng.integers(0, 30)))
        rows.append((None if i % 7 == 0 else i % 50, [None, "en", "fr"][i % 3], text if i % 11 else None, "n"))
    rows += rows[:5] + [(999, "en", "big deal " * 5000, "n"), (1000, "en", "", "n"), (1001, "en", "q" * 3000, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string").repartition(5)
    got = asked(phrases.collocations(docs, most_words, bits=bits, most=40))
    assert got == sorted(plain_collocations([r[1:3] for r in rows], most=40, most_words=most_words)) and len(got) > 20


def test_collocations_of_nothing_and_of_long_texts_cut_in_slices(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "en", " \n")], none.schema)).count() == 0
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE", 40)
    text = "one two three. four five six seven eight nine ten eleven twelve, a b c\nd e f g h " + "w" * 100 + " y. z"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x", "x", "y"]), pa.array(["", text, "short one"])], ["at", "lang", "text"])
    found, powers = Counter(), Powers()
    for body, bounds, rows, langs, _ in phrases.slices(batch):
        words = phrases.Words(body, bounds, powers)
        first, _, _ = words.grams(2, langs[words.doc], powers)
        raw = body.tobytes()
        found.update((int(rows[words.doc[i]]), raw[words.start[i] : words.stop[i + 1]].decode()) for i in first)
    want = Counter((1, f"{a} {b}") for p in re.split(r"[.,\n]", text) for a, b in zip(p.split(), p.split()[1:]))
    assert found == want + Counter([(2, "short one")])


def plain_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 40)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(blocks, min_size=1, max_size=3), st.sampled_from([(24, 3), (6, 3), (3, 3), (12, 4)]))
def test_runs_equal_brute_force(made, bound):
    docs = [[x for part, size in b for x in (part * size)[:size]] for b in made]
    bounds, ids, want = [0], [], []
    for d, doc in enumerate(docs):
        want += [(s + bounds[-1], e + bounds[-1], q) for s, e, q in plain_runs(doc, *bound)]
        ids += [x + 4 * d for x in doc]
        bounds.append(len(ids))
    ids = np.array(ids, np.int64)
    assert [tuple(r) for r in runs_of(ids, np.array(bounds), Powers(), *bound).tolist()] == want
    g = re_pair(ids)

    def words(s):
        return [s] if s < g.terminals else words(g.left[s - g.terminals]) + words(g.right[s - g.terminals])

    assert [x for s in g.symbols.tolist() for x in words(s)] == ids.tolist()
    pairs = Counter(p for p in zip(g.symbols.tolist(), g.symbols.tolist()[1:]) if p[0] != p[1])
    assert all(v == 1 for v in pairs.values())


def test_the_registered_runs_equal_brute_force(spark, data):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want = plain_runs(w)
        gone = {k for s, e, q in want for k in range(s + q, e)}
        best = min(want, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
        r = got[i]
        told = "".join(f"{s},{e - s},{q}\n" for s, e, q in want)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_runs"], r["runs_sha256"]) == (len(want), hashlib.sha256(told.encode()).hexdigest())
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4)
        some += len(want)
    assert some > 10


def test_runs_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "a " * 30, 3), (1, "a " * 30, 3), (2, "  " * 24, 4), (3, "x y " * 50_000, 5), (4, " ".join(map(str, range(3000))), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = {(r["row"]["doc_id"], r["row"]["runs"]): r for r in runs.periodic_runs(docs).collect()}
    assert len(found) == 6 and all(found[k]["runs"] == [] and found[k]["best"] is None for k in ((None, 1), (1, 2), (4, 6)))
    assert found[1, 3]["best"].asDict() == {"start": 0, "length": 30, "period": 1} and found[1, 3]["text"] == "a"
    assert found[2, 4]["words"] == 24 and found[3, 5]["text"] == "x y" and found[3, 5]["words"] == 100_000
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=2)


def test_language_of_held_out_documents(spark, data):
    got = {r["doc_id"]: r for r in queries.op13_language(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    word = {"aa": ["ruto", "mela", "siva"], "bb": ["qwix", "zzork", "phlim"], "ça": ["été", "çâu", "ïlé"]}
    rows = [(i, x, " ".join(rng.choice(word[x], 12)), "y") for i in range(90) for x in [list(word)[i % 3]]]
    odd = [(None, None, None, "y"), (500, "aa", "", "y"), (501, None, "12 34 !", "y"), (502, "bb", "mela RUTO siva", "y"), (502, "bb", "mela RUTO siva", "y"), (503, None, "été çâu " * 40_000, "y"), (504, None, "щюжд фвыа", "y")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string, nearest string")
    model = language.fit(docs.where("doc_id < 90"), sample_rows=20)
    assert set(model.langs) == {"aa", "bb", "ça"} and len(model.langs) <= 12
    found = language.identify(docs, model)
    got = {r["row"]["doc_id"]: r for r in found.collect()}
    assert found.count() == 97 and all(got[i]["nearest"] == x for i, x, _, _ in rows)
    for i in (None, 500, 501):
        assert (got[i]["lang"], got[i]["nearest"], got[i]["score"], got[i]["far"]) == ("und", "und", 0.0, True)
    assert got[502]["nearest"] == "aa" and got[503]["nearest"] == "ça"
    assert got[504]["lang"] == "und" and got[504]["far"] and got[504]["nearest"] in word
    again = language.fit(docs.where("doc_id < 90").repartition(7), sample_rows=20)
    assert np.allclose(model.centroids, again.centroids)
    none = language.fit(docs.limit(0))
    assert {r["nearest"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_counting_holds_few_copies_of_its_sequences():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 20_000))) for _ in range(110)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["en"] * len(texts)), pa.array(texts)], ["at", "lang", "text"])
    found = 0
    tracemalloc.start()
    for out in phrases._counted((0, 1), None, 64)(iter([batch])):
        found += sum(n for size, n in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True) if size == 1)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print("peak MB", peak)
    assert found == 110 * 20_000
    assert peak < 150
