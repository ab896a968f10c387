"""Media columns, URL filter, near duplicates, neighbours and toxicity."""

import random

import numpy as np
import pytest

from chronoframe.llm import dartminhash, flac, rpforest, toxicity, urls

# ---- FLAC ---------------------------------------------------------------------------


def payloads():
    rng = np.random.default_rng(0)
    wave = (np.sin(np.arange(6400) / 20) * 100 + 128).astype(np.uint8).tobytes()
    return [flac.payload(t)[0] for t in (None, "", "a", "é" * 5000, "plain text " * 700)] + [
        rng.integers(0, 256, 6400).astype(np.uint8).tobytes(), bytes(1024), b"\xff\xf8" * 1600,
        b"\xff\xf8\x75\x02\x01\x03\xff\x00" * 320, wave,
    ]


@pytest.mark.parametrize("lpc", [None, ([8000, -3900], 12), ([100, 20, 3, 0, -7], 7)])
def test_flac_round_trip(lpc):
    data = payloads()
    media = flac.encode(data, lpc)
    assert flac.decode(media) == data
    assert [flac.encode([p], lpc)[0] for p in data] == media
    assert all(flac.info(m).samples == len(p) for m, p in zip(media, data, strict=True))


def test_flac_seeks():
    data = payloads()[3] * 4
    stream = flac.encode([data])[0]
    for at, n in ((0, 10), (5000, 3000), (20_000, 70), (len(data) - 5, 100), (len(data) + 3, 4)):
        assert flac.read_samples(stream, at, n) == data[at : at + n]


@pytest.mark.parametrize("place", [0.3, 0.5, 0.9, 0.999])
def test_flac_checksums(place):
    stream = bytearray(flac.encode([payloads()[4]])[0])
    stream[int(len(stream) * place)] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_flac_columns(spark):
    df = spark.createDataFrame([(1, "ab" * 3000), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    blocks = flac.pcm_blocks(flac.write(df)).orderBy("doc_id", "sample_offset").collect()
    whole = b"".join(bytes(r.pcm) for r in blocks if r.doc_id == 1)
    assert whole.rstrip(b"\0").decode() == "ab" * 3000
    assert [r.sample_offset for r in blocks if r.doc_id == 1] == list(range(0, 6016, flac.BLOCK))
    got = flac.digests(df).collect()
    assert len(got) == 4 and len({r.media_sha256 for r in got}) == 2
    assert flac.digests(df.limit(0)).count() == 0


# ---- URLs ---------------------------------------------------------------------------


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        r for r, _ in urls.RULES
        if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])
    ]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    given = ["http://A.EXAMPLE.org/es/1", "https://example.org/en/12?x", "http://x.org", "http://x.org/", "http://a.com/fr/", "http://com/de/#f",
             "http://notexample.org/es/", "nothing", None, "", "://", "http://É.org/x", "a://b://c.com/fr/1?://", "http://x.net/a"] * 5
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u in enumerate(given):
        r = got[i]
        assert (r.host, r.path, r.rule) == judged(u), u
        assert r.verdict == dict(urls.RULES)[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=8))
    rows = [(f"http://{word('aeimno')}.org/{i}", True) for i in range(300)] + [(f"http://{word('qxzkvj')}.com/de/{i}", False) for i in range(300)]
    add, threshold = urls.fit(spark.createDataFrame(rows, "url string, accepted boolean"))
    asked = [(f"http://{word(letters)}.net/", letters) for letters in ("aeimno", "qxzkvj") for _ in range(50)]
    out = add(spark.createDataFrame([*asked, (None, None), ("", "")], "url string, kind string")).collect()
    assert sum(r.difference >= threshold for r in out if r.kind == "aeimno") > 45
    assert sum(r.difference < threshold for r in out if r.kind == "qxzkvj") > 45
    assert [r.difference for r in out if not r.url] == [0, 0]


@pytest.mark.parametrize("most", [0, 10**6])
def test_url_differences(spark, monkeypatch, most):
    """Both ways, against counts in plain dictionaries."""
    monkeypatch.setattr(urls, "GRAMS", most)
    given = [("http://a.org/é", True), ("http://b.com/de/1", False), ("http://b.com/de/1", False), ("http://aa.org/", True), (None, True)] * 2
    counted: list[dict] = [{}, {}]
    for u, ok in given:
        data = b"\0" * urls.ORDER + (u or "").encode()
        for i in range(urls.ORDER, len(data)):
            for k in range(urls.ORDER + 1):
                for key in (data[i - k : i + 1], (data[i - k : i],)):
                    counted[not ok][k, key] = counted[not ok].get((k, key), 0) + 1

    def brute(u):
        data, total = b"\0" * urls.ORDER + (u or "").encode(), 0.0
        for i in range(urls.ORDER, len(data)):
            p = [1 / 256] * 2
            for k in range(urls.ORDER + 1):
                p = [
                    (c.get((k, data[i - k : i + 1]), 0) + urls.STRENGTH * q) / (c.get((k, (data[i - k : i],)), 0) + urls.STRENGTH)
                    for c, q in zip(counted, p, strict=True)
                ]
            total += np.log(p[0]) - np.log(p[1])
        return total / max(1, len(data) - urls.ORDER)

    add, _ = urls.fit(spark.createDataFrame(given, "url string, accepted boolean"))
    asked = ["http://a.org/x", "ftp://zz", "é", "", None, "http://b.com/de/" * 900]
    got = {r.url: r.difference for r in add(spark.createDataFrame([(u, 1) for u in asked], "url string, n int")).collect()}
    assert all(got[u] == pytest.approx(brute(u), abs=1e-9) for u in asked)


# ---- near duplicates ----------------------------------------------------------------


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)] * 4
    for i in range(60):
        t = list(base)
        for _ in range(i % 8):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [None, "", " ", "", "one two", "One  TWO", "one", "y " * 500, "y " * 600]
    return texts + [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]


@pytest.mark.parametrize("large,block", [(32, 256), (3, 4)])
def test_classes_match_brute_force(spark, monkeypatch, large, block):
    monkeypatch.setattr(dartminhash, "LARGE", large)
    monkeypatch.setattr(dartminhash, "BLOCK", block)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, same string")
    got = dict(dartminhash.classes(df).collect())
    assert [got[i] for i in range(len(texts))] == brute(texts)
    kept = dartminhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))


@pytest.mark.parametrize("times", [2, 4, 10])
def test_classes_of_repeated_passages(spark, times):
    rng = random.Random(times)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(20):
        body, line = (" ".join(rng.choices(words, k=k)) for k in (100, 60))
        texts += [body, f"{body} " * times, f"{body} extra {line}", f"{body} extra {f'{line} ' * times}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(dartminhash.classes(df).collect())
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (5, "A b C")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in dartminhash.dedup(df).collect())
    assert got == [(False, 4), (True, 0), (True, 0)]
    assert dartminhash.classes(df.limit(0)).count() == 0


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    e, w = rng.integers(0, 2**63, 900).astype(np.uint64), 1 + np.log(rng.integers(1, 9, 900))
    a, b = dartminhash.darts([(e[:600], w[:600]), (e[300:], w[300:])], 2000)
    true = w[300:600].sum() / w.sum()
    assert abs((a == b).mean() - true) < 0.04
    assert (dartminhash.darts([(e[300:], w[300:])], 2000)[0] == b).all()


# ---- neighbours ---------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:800] = x[500]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] + [0.0] * 14), (5400, [1.0]), (None, x[3].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    out = rpforest.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    assert {r.query for r in out} == set(range(0, 1500, 100))
    x, right = x.astype(float), 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10].tolist()
        mine = sorted((r for r in out if r.query == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[r.id]) < 1e-12 for r in mine)
        right += len({r.id for r in mine} & set(best))
    assert right >= 0.9 * 150
    few = rpforest.nearest(df.where("vec_id IN (0, 1)"), "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    assert [(r.query, r.id) for r in few] == [(0, 1)]
    assert rpforest.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


# ---- toxicity -----------------------------------------------------------------------


def test_restore():
    words = ["idiot", "moron", "scum", "the", "people", "house", "clown", "lost", "stupid"]
    model = toxicity.LetterModel(toxicity.trigrams(" ".join(words) for _ in range(200)))
    got = [toxicity.restore(w, model) for w in ("1d10t", "m0r0n", "$cum", "i.d.i.o.t", "idiiiiot", "stup1d", "c1own", "house")]
    assert got == ["idiot", "moron", "scum", "idiot", "idiot", "stupid", "clown", "house"]


def test_toxicity_learns_and_sees_through(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioustnrl", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        t = rng.choices(words, k=40)
        toxic = i % 5 == 0
        if toxic:
            t[3:3] = ["moron", "scum"]
        rows.append((i, " ".join(t), i, "x"))
        labels.append((i, int(toxic)))
    rows += [(1001, "what a m0r0n and s.c.u.m", 0, ""), (1002, "m o r o n scuuuum", 0, ""), (1003, None, 0, ""), (1004, "", 0, ""), (1005, "plain words", 0, ""), (None, "moron scum", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, toxic string")
    lab = spark.createDataFrame([*labels, (None, 1), (1005, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    out = {r.doc_id: r.score for r in toxicity.scored(docs, model).select("doc_id", "score").collect()}
    assert all((out[i] >= 0.7) == (i % 5 == 0) for i in range(900))
    assert out[1001] >= 0.7 and out[1002] >= 0.7 and out[None] >= 0.7
    assert out[1003] == out[1004] == out[1005] < 0.7
    kept = toxicity.filter_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == 720 + 3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()] == [0.0]
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
