"""The training-data operators on small tables, against brute force, round trips and held-out accuracy."""
import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyrine.llm import ann, chat, components, decontaminate, langid, quality, queries, sampling, simhash, suffix_dedup, toxicity, warc
from papyrine.llm import sentencepiece_codec as codec
from papyrine.llm.common import drop_ids, fold, split_by_keys
from tests.harness import connect, rows

LONG = "palabra unica " * 9000
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "uno dos"), (4, "uno dos"), (5, LONG), (6, LONG), (None, "sin id"), (7, "é日本🙂 \x00 ▁x")]


@pytest.fixture
def odd(spark):
    """Nulls, blanks, repeated rows, long texts, a null id, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("fp", "score", "ids", "n_tokens", "severity", "words", "spans", "id", "tag")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# 1. SentencePiece ----------------------------------------------------------------------------------


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_codec_is_the_library():
    own, lib = codec.Codec(codec.PieceModel.load(queries.tokenizer_path())), _library()
    rng = np.random.default_rng(3)
    signs = list("abthein ▁▁  é\n\t.,0日🙂<>/s")
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(signs, rng.integers(1, 80))) for _ in range(3000)] + ["a" * 3000, " " * 200, "<s> </s> <0x0A>"]
    for t in texts:
        ids = lib.encode(t, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)


def test_codec_steps_back():
    """A text whose longest matches do not lead to an encoding."""
    model = codec.PieceModel(["<unk>", "a", "b", "c", "ab", "bc", "abc"][:6], [0, 0, 0, 0, -2, -1], {}, {0}, 0, 0, False)
    model.reachable = [1, 2, 3, 4, 5]
    own = codec.Codec(model)
    assert [model.pieces[i] for i in own.symbols("abc")] == own.merger.merge("abc") == ["a", "bc"]
    assert model.pieces[own._longest("abc", 0)] == "ab"  # the longest match is a dead end


def test_op1(spark, sf_dir):
    lib = _library()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    for r in queries.op1_sentencepiece(spark, sf_dir).collect():
        ids = lib.encode(docs[r["doc_id"]], add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_codec_frames(odd, empty):
    path, lib = queries.tokenizer_path(), _library()
    both = codec.decode(codec.encode(odd, path), path).select("text", "ids", "decoded").collect()
    for r in both:
        assert r["ids"] == lib.encode(r["text"] or "", add_eos=True) and r["decoded"] == lib.decode(r["ids"])
    assert codec.encode(empty, path).count() == 0


# 2, 3, 6. Classifiers ------------------------------------------------------------------------------


def test_toxicity_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = fold("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.filter(~held))
    got = toxicity.score(docs.join(labels.filter(held), "doc_id"), model).select("toxic", toxicity.is_rejected(F.col("severity")).alias("rejected")).toPandas()
    caught, wrong = got[got.toxic == 1].rejected, got[got.toxic == 0].rejected
    print("held out:", caught.sum(), len(caught), wrong.sum(), len(wrong))
    assert caught.mean() > 0.85 and wrong.mean() < 0.02 and len(caught) > 100


def test_op2(spark, sf_dir):
    got = queries.op2_toxicity(spark, sf_dir).toPandas()
    assert got.severity.between(0, 2).all() and set(got.doc_id) == set(pd.read_parquet(f"{sf_dir}/documents.parquet").doc_id)


def test_cumulative_link_is_the_optimum():
    """Against the dense likelihood, plainly written: the penalised objective has no slope where the fit ends."""
    rng = np.random.default_rng(26)
    n, d, l2 = 300, 5, 1e-2
    dense = np.where(rng.random((n, d)) < 0.4, rng.integers(1, 4, (n, d)), 0).astype(float)
    eta = dense @ np.array([1.0, -0.7, 0.4, 0.0, 0.9]) + rng.logistic(size=n)
    grades = np.digitize(eta, [0.5, 2.0])
    rows = [np.flatnonzero(x) for x in dense]
    w, thetas = toxicity.fit_cumulative_link(rows, [x[r] for x, r in zip(dense, rows, strict=True)], grades, d, steps=20_000, l1=0.0, l2=l2)
    scale = 1 / np.sqrt((dense**2).mean(0) + 0.005)

    def objective(p):
        eta = dense @ p[:d]
        upto = np.column_stack([np.zeros(n), *(1 / (1 + np.exp(eta - t)) for t in p[d:]), np.ones(n)])
        likely = upto[np.arange(n), grades + 1] - upto[np.arange(n), grades]
        return -np.log(likely).mean() + l2 / 2 * ((p[:d] / scale) ** 2).sum()

    at = np.array([*w, *thetas])
    slope = [(objective(at + e) - objective(at - e)) / 2e-5 for e in 1e-5 * np.eye(len(at))]
    assert np.abs(slope).max() < 1e-4
    assert objective(at) < min(objective(at + rng.normal(size=len(at)) * 0.1) for _ in range(50))


def test_toxicity_sample(spark):
    """Ids of several texts, ids labelled twice and null labels teach nothing; repeated rows teach once."""
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "d"), (4, "e"), (5, None), (None, "f"), (6, "g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1), (4, 1), (4, 1), (5, 0), (6, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = sampling.labelled_sample(docs, labels, "toxic", [0, 1], 10, "s").collect()
    assert sorted((r["doc_id"], r["toxic"], r["text"]) for r in got) == [(1, 0, "a"), (4, 1, "e"), (5, 0, None)]
    model = toxicity.fit(docs, labels)
    assert model.severity(0.0) <= 2


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 300)
    feature = [np.array([0]) if g else np.array([], int) for g in grades]
    value = [np.array([float(g)]) if g else np.array([]) for g in grades]
    w, thetas = toxicity.fit_cumulative_link(feature, value, grades, 1)
    model = toxicity.OrdinalModel({}, thetas)
    assert thetas[0] < thetas[1] and model.severity(0) < model.severity(w[0]) < model.severity(2 * w[0])


def test_toxicity_odd_rows(spark, odd, empty):
    model = toxicity.OrdinalModel({"=uno": 5.0}, [2.0, 4.0])
    got = toxicity.score(odd, model, out_col="severity").select("doc_id", "text", "severity").collect()
    assert len(got) == len(ODD) and {r["severity"] > 1 for r in got if r["doc_id"] == 4} == {True}
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.severity(0.0) < 1e-9


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    got = queries.op3_quality(spark, sf).toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_quality_is_brute_force(spark, sf_dir):
    """Scores against discriminants computed from all rows at once, without sums, factors or frames."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    both = docs.join(labels, "doc_id").toPandas()
    x = np.array([quality.statistics(t) for t in both.text])
    parts = [x[both.quality == c] for c in (0, 1)]
    within = sum(len(p) * p.var(0) for p in parts) / len(x)
    log_density = []
    for p in parts:
        cov = np.cov(p.T, bias=True) / np.sqrt(np.outer(within, within))
        cov = (1 - quality.SHRINK) * cov + (quality.SHRINK + quality.RIDGE) * np.eye(x.shape[1])
        z = (x - p.mean(0)) / np.sqrt(within)
        log_density.append(np.log(len(p) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    want = 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))
    described = quality.describe(docs)
    model = quality.fit(described, labels)
    got = quality.score(described, model).select("doc_id", "score").toPandas().set_index("doc_id").score
    assert np.allclose(got.loc[both.doc_id].to_numpy(), want, atol=1e-9)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (2, 1), (3, None)], "doc_id long, quality int")
    described = quality.describe(odd)
    model = quality.fit(described, labels)
    assert quality.score(described, model).count() == len(ODD)
    blank = quality.fit(quality.describe(empty), labels)
    assert {r["score"] for r in quality.score(described, blank).collect()} == {0.5}


def test_langid(spark):
    sf = "/root/testdata/sf0.01"
    lang = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").lang
    got = queries.op6_langid(spark, sf).toPandas().set_index("doc_id").join(lang)
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def plain_grams(text):
    """Character 1- to 3-grams as strings: letters folded, all else one gap, a gap at either end."""
    import re

    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    words = folded.split()
    if not words:
        return Counter()
    line = " " + " ".join(words) + " "
    return Counter([c for c in line if c != " "] + re.findall("(?=(..))", line) + re.findall("(?=(...))", line))


def test_langid_grams(sf_dir):
    """Hashed counts against those of the strings themselves."""
    for text in pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()[:60] + ["", "¡Ñandú!  1 x", "日本 ab"]:
        want = defaultdict(int)
        for gram, c in plain_grams(text).items():
            codes = [0 if g == " " else ord(g) for g in gram]
            h = 0
            for code in codes:
                h = (h * 40503 + code) % 2**32
            h = h * (2654435761, 2246822519, 3266489917)[len(gram) - 1] % 2**32
            want[h >> 17] += c
        at, counts = langid.gram_counts(text)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == want


def test_ftrl_step_by_step():
    """Sparse fitting against the same updates over dense vectors, one number at a time."""
    rng, classes, width = np.random.default_rng(27), 3, 12
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(width, 4, replace=False))
        rows.append((at, rng.random(4)))
    y = rng.integers(0, classes, 40)
    z, n = np.zeros((width, classes)), np.zeros((width, classes))

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * langid.L1) / ((langid.BETA + n[i, c] ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(40):
            x = np.zeros(width)
            x[rows[i][0]] = rows[i][1]
            w = np.array([[weight(k, c) for c in range(classes)] for k in range(width)])
            p = np.exp(x @ w) / np.exp(x @ w).sum()
            for k in np.flatnonzero(x):
                for c in range(classes):
                    g = x[k] * (p[c] - (c == y[i]))
                    sigma = ((n[k, c] + g * g) ** 0.5 - n[k, c] ** 0.5) / langid.ALPHA
                    z[k, c] += g - sigma * w[k, c]
                    n[k, c] += g * g
    got = langid.ftrl(rows, y, classes, epochs=2)
    assert np.allclose(got[:width], [[weight(k, c) for c in range(classes)] for k in range(width)]) and not got[width:].any()


def test_langid_idf_and_temperature(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(spark.createDataFrame(docs[["doc_id", "text", "lang"]]))
    seen = Counter(k for t in docs.text for k in langid.gram_counts(t)[0].tolist())
    want = np.log((len(docs) + 1) / (np.array([seen.get(k, 0) for k in range(langid.BUCKETS)]) + 1)) + 1
    assert np.allclose(model.idf, want) and model.langs == sorted(docs.lang.unique())
    at, counts = langid.gram_counts(docs.text[0])
    x = np.log1p(counts) * want[at]
    logits = x / np.sqrt((x**2).sum()) @ model.weights[at] / model.temperature
    assert np.isclose(model.predict(docs.text[0])[1], np.exp(logits - logits.max()).max() / np.exp(logits - logits.max()).sum())


def test_every_language_is_learned(spark):
    """More languages than any bound on the sample would hold in full: each is learned from two rows or more."""
    rng = np.random.default_rng(28)
    letters = [chr(0x4E00 + i) for i in range(600)]
    rows_ = [(300 * k + i, " ".join("".join(rng.choice([a, "a", "b"], 4)) for _ in range(6)), f"l{i:03}") for k in range(8) for i, a in enumerate(letters[:300])]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 300
    got = langid.predict(df, model).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9


def test_langid_odd_rows(spark, odd, empty):
    df = odd.withColumn("lang", F.when(F.col("doc_id") == 4, "es").when(F.col("doc_id") == 7, "xx"))
    model = langid.fit(df.select("doc_id", "text", "lang"))
    got = langid.predict(df, model).collect()
    assert {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    nothing = langid.fit(empty.withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


# 4. Nearest neighbours -----------------------------------------------------------------------------


def test_nearest_recall_and_scores(spark, sf_dir):
    e = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = queries.op4_nearest(spark, sf_dir).toPandas()
    assert set(got.query_id) == set(ids[ids % 20 == 0])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[ids == q][0]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit += len(set(ids[order]) & set(g.vec_id))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        assert np.allclose([s[ids == v][0] for v in g.vec_id], g.score, atol=1e-12)
    assert hit / len(got) >= 0.9


def test_nearest_recall_on_ten_thousand_rows(spark):
    """Recall at 20 against brute force over all rows of a larger table."""
    vectors = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").limit(10_200).select("vec_id", "embedding").persist()
    e = vectors.toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = ann.search(vectors, F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += (s[np.isin(ids, g.vec_id)] >= np.sort(s)[-20] - 1e-12).sum()
    print("recall:", hit / len(got), len(ids))
    assert hit / len(got) >= 0.9 and len(ids) >= 10_000


@pytest.mark.parametrize(("kind", "noise"), [("float", 0.005), ("double", 0.0001)])
def test_nearest_tells_near_copies_apart(spark, kind, noise):
    """One group of near copies and a vector with a large component, against brute force."""
    rng = np.random.default_rng(18)
    centre, e = rng.normal(size=32), rng.normal(size=(1000, 32))
    x = centre / np.linalg.norm(centre) + noise * e / np.linalg.norm(e, axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1] = 0
    x[1, 3] = 1e6
    x = x.astype(np.float32 if kind == "float" else np.float64).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 1000, 20), 20)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(1000), -s))[:20]) & set(g.vec_id))
    assert hit / len(got) >= 0.9


def test_nearest_moves_little_beside_its_input(spark):
    """What is shuffled stays within a few times the vectors; every query has its rows, in order and with exact scores."""
    x = np.random.default_rng(20).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").persist()
    df.count()
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert moved() - before < 10 * x.nbytes
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 4000, 20), 20)
    x, hit = x.astype(float), 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(1)
        assert np.array_equal(s[g.sort_values("rank").vec_id], g.sort_values("rank").score)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(4000), -s))[:20]) & set(g.vec_id))
    assert hit / len(got) >= 0.9


def test_nearest_tells_copies_ties_and_ids(spark):
    """Copies in every list, ids that name several vectors, scores that tie: as brute force over distinct (id, vector) has them."""
    rng = np.random.default_rng(21)
    x = rng.integers(-1, 2, size=(700, 3)).astype(float)
    ids = rng.integers(0, 400, size=700)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    there = {(int(i), tuple(v)) for i, v in zip(ids, x, strict=True) if v.any()}
    want, hit = 0, 0
    for q in {i for i, _ in there if i % 20 == 0}:
        best: dict[int, float] = {}
        for a in (v for i, v in there if i == q):
            for i, v in there:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), sum(m * n for m, n in zip(a, v, strict=True)))
        order = sorted(best.items(), key=lambda c: (-c[1], c[0]))[:20]
        assert sum((q, n) in got for n in range(1, 21)) == len(order)
        want, hit = want + len(order), hit + sum(got[q, n] == c for n, c in enumerate(order, 1))
    assert len(got) == want and hit / want >= 0.9


def test_nearest_odd_vectors(spark):
    nan = float("nan")
    vectors = [(i, [1.0, 0.0]) for i in range(40)] + [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [None, 1.0]), (120, [0.5, 0.5]), (140, [1.0]), (0, [1.0, 0.0]), (160, [1e6, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 20, 120, 160}
    near = got[got.query_id == 0].sort_values("rank")
    assert list(near.vec_id) == [160, *range(1, 20)] and near.score.iloc[1] == 1.0
    few = ann.search(df.filter("vec_id in (0, 120)"), F.col("vec_id") % 20 == 0).toPandas()
    assert sorted(zip(few.query_id, few.vec_id, strict=True)) == [(0, 120), (120, 0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 5. WARC -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c", None), (4, "http://d\r\nX: y", ""), (5, "u", "ñ" * 50000), (5, "u", "ñ" * 50000), (None, "n", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "size": F.lit(2)})
    path = str(tmp_path / "w")
    warc.write_archive(df, path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(pages) and spark.read.parquet(f"{path}/payloads").count() == 3
    for r in got:
        body = next((h or "").encode() for i, _, h in pages if i == r["id"])
        assert bytes(r["payload"]) == body
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head + b"\r\n\r\n" == bytes(r["header"])
        assert rest == (body if r["record_type"] == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(rest) - 4}".encode() in head
    kinds = {(r["id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2)}


def test_warc_empty_and_damaged(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    warc.write_archive(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0
    for name, change in (("damaged", {"payloads": F.lit(warc.write_packed(b"y"))}), ("differ", {"headers": F.expr("cast(replace(cast(header as string), 'Content-Length: 1', 'Content-Length: 2') as binary)")})):
        path = tmp_path / name
        warc.write_archive(df, str(path / "a"))
        for part, column in (("payloads", "packed"), ("headers", "header")):
            got = spark.read.parquet(str(path / "a" / part))
            got.withColumn(column, change.get(part, F.col(column))).write.parquet(str(path / "b" / part))
        with pytest.raises(Exception, match=name):
            warc.read_archive(spark, str(path / "b")).collect()


# 5, 7, 10 against SQL ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(queries.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


# 7. Chat -------------------------------------------------------------------------------------------


def test_chat(spark):
    turns = [(1, 0, "system", "sys"), (1, 1, "ana", "hola <|x|>"), (1, 2, "ben", None), (1, 70, "ana", "fin"), (2, 0, "system", "only"), (3, None, None, "a"), (3, 1, "b", "c"), (3, 1, "b", "c"), (None, 0, "z", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = chat.rotate(df).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["segment"]):
        by[r["conv_id"], r["perspective"]].append(r)
    assert set(by) == {(1, "ana"), (1, "ben"), (3, "unknown"), (3, "b"), (None, "z")}
    ana = by[1, "ana"]
    whole = "".join(r["rendered"] for r in ana)
    assert whole == "<|system|>\nsys<|end|>\n<|assistant|>\nhola < |x|><|end|>\n<|user name=ben|>\n<|end|>\n<|assistant|>\nfin<|end|>\n"
    assert [r["start_char"] for r in ana] == [0, len(ana[0]["rendered"])]
    masked = [whole[r["start_char"] + m["start"] : r["start_char"] + m["end"]] for r in ana for m in r["mask"]]
    assert masked == ["hola < |x|><|end|>\n", "fin<|end|>\n"]
    assert len(by[3, "b"][-1]["mask"]) == 2


def test_chat_chunks(spark, monkeypatch):
    """Starts follow the rendered lengths over many segments, whatever a chunk holds; texts as ids, too."""
    turns = [(c, t, r, "x" * (t % 7)) for c in ("a", "b", None) for t in range(0, 1500, 3) for r in (["ana", "ben", "system"][t % 3 :] if t % 2 else ["ben"])]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    monkeypatch.setattr(chat, "CHUNK", 3)
    by = defaultdict(list)
    for r in sorted(chat.rotate(df).collect(), key=lambda r: r["segment"]):
        by[r["conv_id"], r["perspective"]].append(r)
    assert {p for _, p in by} == {"ana", "ben"} and all(len(v) == 24 for v in by.values())
    for v in by.values():
        at = np.cumsum([0] + [len(r["rendered"]) for r in v])
        assert [r["start_char"] for r in v] == at[:-1].tolist()


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(df).count() == 0


# 8. Suffix dedup -----------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = True
        cover = cover[: len(r)]
        kept = bytes(np.frombuffer(r, np.uint8)[~cover])
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((len(r), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _noise(rng, n):
    return "".join(rng.choice(list("abcdefghij klmñ"), n))


def dedup_texts():
    rng = np.random.default_rng(1)
    part, other = _noise(rng, 260), _noise(rng, 200)
    texts = [_noise(rng, 300) + part + _noise(rng, 50), part + _noise(rng, 400), _noise(rng, 90) + part[30:229] + _noise(rng, 20), other, _noise(rng, 5) + other[:199], other + other, "x" * 650, "ab" * 400, None, "", "short", _noise(rng, 1500)]
    texts += [texts[-1], texts[-1][:700] + "!" + texts[-1][701:], ("linea repetida de prueba\n" * 40) + _noise(rng, 300), _noise(rng, 120) + "linea repetida de prueba\n" * 12]
    for _ in range(25):
        base = _noise(rng, int(rng.integers(200, 900)))
        cut = sorted(rng.integers(0, len(base), 2))
        texts += [base, _noise(rng, 30) + base[cut[0] : cut[1]] + _noise(rng, 260)]
    return texts


def test_suffix_dedup_is_brute_force(spark):
    texts = dedup_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(df).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_op8_is_brute_force(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op8_suffix_dedup(spark, sf_dir).collect()}
    assert got == dict(zip(docs.doc_id, brute_repeats(docs.text), strict=True))


def test_suffix_dedup_odd_rows(odd, empty):
    got = suffix_dedup.deduplicate(odd).collect()
    assert len(got) == len(ODD)
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (5, 6))
    assert suffix_dedup.deduplicate(empty).count() == 0
    again = suffix_dedup.rewrite(odd)
    assert again.columns == odd.columns and again.count() == len(ODD)


def test_suffix_dedup_tells_rows_apart_by_text(spark):
    """Ids that are null or shared by several texts, against brute force; pieces of long texts change nothing."""
    texts = dedup_texts()
    for ids in ([None] * len(texts), [i // 3 for i in range(len(texts))]):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
        got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(df).collect())
        assert got == sorted(brute_repeats(texts))


def test_long_texts_go_piece_by_piece(monkeypatch):
    """Every window has the anchor it has in one piece, and digests are those of the contexts' bytes."""
    raw = _noise(np.random.default_rng(25), 3000).encode()

    def owners():
        gram, da, db, first, last, at = suffix_dedup.anchors(raw)
        assert first[0] == 0 and last[-1] == len(raw) - 200 and (first[1:] == last[:-1] + 1).all()
        for f, e, a, b in zip(first, last, da, db, strict=True):
            assert hashlib.sha256(raw[f : e + 200]).digest()[:16] == a.tobytes() + b.tobytes()
        return np.repeat(at, last - first + 1).tolist(), np.repeat(gram, last - first + 1).tolist()

    whole = owners()
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    assert owners() == whole


def border_texts(rng, count):
    """A passage that every text holds with unlike text around it, cut here and there: many contexts of one anchor."""
    passage, texts = _noise(rng, 420), []
    for i in range(count):
        cut, end = (0, 420) if i % 4 else sorted(int(x) for x in rng.integers(0, 420, 2))
        texts.append(_noise(rng, int(rng.integers(0, 150))) + passage[cut:end] + _noise(rng, int(rng.integers(0, 150))))
    return texts


def test_common_borders_are_dealt_out(spark, monkeypatch):
    texts = border_texts(np.random.default_rng(32), 120) + dedup_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = dict(enumerate(brute_repeats(texts)))
    for hot in (3, 20, 10**6):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(df).collect()}
        assert got == want


def test_equal_windows_share_a_range():
    """Contexts that hold an equal window at one place share the key of that place's range."""
    rng = np.random.default_rng(33)
    for _ in range(200):
        window, place = bytes(rng.integers(97, 99, 200, np.uint8)), int(rng.integers(0, 137))
        shared = []
        for _ in range(2):
            left, right = int(rng.integers(0, 137 - place)), int(rng.integers(0, place + 1))
            context = bytes(rng.integers(0, 255, left, np.uint8)) + window + bytes(rng.integers(0, 255, right, np.uint8))
            shared.append(set(suffix_dedup.core_keys(5, left + place, left + right, context)))
        assert shared[0] & shared[1]


def test_sampled_sort_needs_equal_places():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(0, 4, 420, np.uint8) + 97)
    contexts = [body[:300], b"z" + body[1:300], body[:300]]
    groups, off, sizes = np.array([0, 0, 1]), np.array([60, 60, 60]), np.array([300] * 3)
    ctx, start = suffix_dedup.repeated_windows(groups, off, sizes, b"".join(contexts))
    assert sorted(zip(ctx.tolist(), start.tolist(), strict=True)) == [(c, s) for c in (0, 1) for s in range(1, 101)]


# 9. SimHash ----------------------------------------------------------------------------------------


def _roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_bk_tree_finds_all():
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    values = list(dict.fromkeys(base + [b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base]))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert {tree.values[i] for i, _ in tree.within(v, 3)} == {w for w in values if (v ^ w).bit_count() <= 3}


def test_links_lose_no_component(spark):
    rng = np.random.default_rng(5)
    values = []
    for b in rng.integers(0, 1 << 63, 60):
        v = int(b)
        for _ in range(4):
            values.append(v)
            for k in rng.choice(64, 3, replace=False):
                v ^= 1 << int(k)
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = simhash.links(df).collect()
    place = {simhash.signed(v): i for i, v in enumerate(values)}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert _roots(len(values), [(place[r["u"]], place[r["v"]]) for r in got]) == _roots(len(values), pairs)
    assert len(got) <= len(simhash.shard_keys("fp", 3)) * len(values)


def test_simhash_components(spark, odd, empty):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(odd).collect()}
    assert {v for (i, fp), v in got.items() if fp == 0} == {1}
    assert got[5, next(fp for i, fp in got if i == 5)] == 5 and got[6, next(fp for i, fp in got if i == 6)] == 5
    assert simhash.components(empty).count() == 0


def test_op9_is_brute_force(spark, sf_dir):
    """Fingerprints and components of whole documents against a plain version of the contract."""
    import xxhash

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    texts, ids = [*docs.text, None, "", "Uno DOS", "uno\tdos", "É É é"], [*docs.doc_id, *range(10**6, 10**6 + 5)]
    fps = []
    for t in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(dict.fromkeys(map(ord, "\t\n\r\x0b\x0c"), " ")).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    distinct = np.array(sorted(set(fps)), np.uint64)
    u, v = np.nonzero(np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= 3)
    roots = _roots(len(distinct), [(i, j) for i, j in zip(u.tolist(), v.tolist(), strict=True) if i < j])
    root_of = {int(f): r for f, r in zip(distinct, roots, strict=True)}
    least = defaultdict(lambda: 1 << 60)
    for i, f in zip(ids, fps, strict=True):
        least[root_of[f]] = min(least[root_of[f]], i)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.components(df).collect()}
    assert got == {i: (simhash.signed(f), least[root_of[f]]) for i, f in zip(ids, fps, strict=True)}


def test_components_of_a_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
    assert components.connected_components(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, 1), (2, None), (3, 4), (3, 4)], "u long, v long")
    assert {tuple(r) for r in components.connected_components(lost).collect()} == {(3, 3), (4, 3)}


def test_component_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "x y z w v"), (4, "x y z w v")], "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in simhash.components(df).collect())))
    assert got == sorted(map(str, [(None, None), (None, None), (None, 4), (4, 4)]))


def near_groups(texts, ids, words=5, similarity=0.8):
    sets = [set(simhash.shingles(t, words)) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    roots = _roots(len(texts), pairs)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(roots):
        least[r] = min(least[r], ids[i])
    return {ids[i]: least[r] for i, r in enumerate(roots)}


def edited(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), int(len(out) * share), replace=False):
        out[i] = f"w{rng.integers(10**6)}"
    return out


def test_near_duplicates_are_brute_force(spark, sf_dir):
    rng = np.random.default_rng(6)
    texts = list(pd.read_parquet(f"{sf_dir}/documents.parquet").text) + [None, "", "a b", "a b"]
    for n, share in ((300, 0.01), (200, 0.02), (120, 0.03), (400, 0.015)):
        base = [f"v{rng.integers(5000)}" for _ in range(n)]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, share)) for _ in range(8)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == near_groups(texts, ids)
    kept = simhash.keep_one(df.unionByName(df.limit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_whose_passages_repeat_unequally(spark):
    rng = np.random.default_rng(16)
    texts = []
    for size in [1, 3, 5, 9] * 10:
        base = [f"v{rng.integers(10**6)}" for _ in range(200)]
        passage = [f"r{rng.integers(10**6)}" for _ in range(size)]
        texts += [" ".join(base + passage * 2), " ".join(edited(rng, base, 0.005) + passage * 60)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    want = near_groups(texts, ids)
    assert len(set(want.values())) == len(texts) // 2
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(df).collect()} == want


def test_no_unique_document_goes_for_its_id(spark):
    """Null ids and ids that several texts share: every class of texts keeps one row, whatever the ids."""
    rng = np.random.default_rng(21)
    texts = [" ".join(f"u{rng.integers(10**6)}" for _ in range(80)) for _ in range(5)]
    near = texts[0] + " more"
    some = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (2, texts[3]), (2, texts[4]), (2, texts[4]), (7, near), (None, None), (8, "")]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumns({"row_a": F.lit(1), "root": F.lit(2), "node": F.rand(1)})
    kept = simhash.keep_one(df.repartition(3))
    assert sorted(str(r["text"]) for r in kept.collect()) == sorted([near, texts[1], texts[2], texts[3], texts[4], ""])
    assert kept.columns == df.columns
    got = {(r["doc_id"], r["row_a"]): r["root"] for r in simhash.near_duplicates(df).collect()}
    assert len(set(got.values())) == 6
    lost = simhash.keep_one(spark.createDataFrame([(None, t) for t in texts + texts[:2]], "doc_id long, text string"))
    assert sorted(r["text"] for r in lost.collect()) == sorted(texts)


def chain(rng, sizes, count):
    """``count`` groups of leading words of one sequence."""
    out = []
    for _ in range(count):
        base = [f"c{rng.integers(10**6)}" for _ in range(max(sizes))]
        out += [" ".join(base[:n]) for n in sizes]
    return out


def test_links_between_members_of_leaders(spark):
    """A link that alone joins two members, neither of which is the other's leader."""
    rng = np.random.default_rng(22)
    texts = [t for sizes in [(204, 202, 163), (104, 119, 139, 164), (8, 9), (12, 14, 16, 19)] for t in chain(rng, sizes, 60)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    want = near_groups(texts, ids)
    assert len(set(want.values())) == 240
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(df).collect()} == want


def test_large_shards_are_cut(spark, monkeypatch):
    for name, value in (("LEAD_ROWS", 7), ("BLOCK_ROWS", 5), ("CLUSTER_ROWS", 30)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(23)
    texts = chain(rng, (204, 202, 163), 5)
    for share in (0.01, 0.02, 0.03):
        base = [f"v{rng.integers(5000)}" for _ in range(150)]
        texts += [" ".join(edited(rng, base, share)) for _ in range(60)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(df).collect()} == near_groups(texts, ids)


def test_links_of_a_group_join_what_all_pairs_join():
    """Components by links against those of all similar pairs, whole and cut into blocks that meet two by two."""
    rng = np.random.default_rng(24)
    members, sets = [], []
    for i in range(150):
        if i % 30 == 0:
            base = rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
        own = base.copy()
        own[rng.choice(100, rng.integers(0, 16), replace=False)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(own))
        members.append((i, simhash.fold_bits(sets[-1]), len(sets[-1]), int(rng.choice([i - i % 30, 1000 + i]))))
    joined = [(i, j) for i in range(150) for j in range(i) if members[i][3] == members[j][3]]
    similar = [(i, j) for i in range(150) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    want = _roots(150, joined + similar)
    found = simhash.group_links(members, [0] * 150, sets, 0.8)
    assert _roots(150, joined + found) == want and len(found) == len(set(_roots(150, joined))) - len(set(want)) > 10
    assert {tuple(sorted(p, reverse=True)) for p in found} <= set(similar)
    parts = []
    for a in range(3):
        for b in range(a, 3):
            at = [i for i in range(150) if i % 3 in (a, b)]
            parts += simhash.group_links([members[i] for i in at], [i % 3 for i in at], [sets[i] for i in at], 0.8)
    assert _roots(150, joined + parts) == want


# 10. Decontamination -------------------------------------------------------------------------------


def test_decontamination(spark, empty):
    rng = np.random.default_rng(7)
    item = [f"b{rng.integers(10**6)}" for _ in range(40)]
    words = lambda n: [f"d{rng.integers(10**6)}" for _ in range(n)]
    one = list(item)
    one[20] = "changed"
    texts = [" ".join(words(30) + item + words(30)), " ".join(words(200)), "  ".join(words(3) + item).upper(), " ".join(words(9) + item[:20] + words(20)), " ".join(one), None, "", "tiny item", " ".join(item * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"item_id": F.lit(9), "m": F.lit(0), "h": F.lit(0)})
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny  ITEM"), (3, None), (4, ""), (1, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 6)) for r in decontaminate.find(docs, items).collect()}
    assert got == {(0, 1): (30, 1.0), (2, 1): (3, 1.0), (7, 2): (0, 1.0), (8, 1): (0, 1.0)} | ({(4, 1): (0, round(31 / 41, 6))} if 31 / 41 >= 0.8 else {})
    clean = decontaminate.clean(docs, items)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 3, 4, 5, 6] and clean.columns == docs.columns
    assert decontaminate.find(empty, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(texts)


def test_documents_shorter_than_the_item(spark):
    rng = np.random.default_rng(17)
    benchmark, texts = [], []
    for n in (6, 9, 12, 24, 40, 59):
        item = [f"c{rng.integers(12)}" if n == 24 else f"b{rng.integers(10**6)}" for _ in range(n)]
        benchmark.append(item)
        texts += [item[cut:] for cut in range(n)] + [item[: n - cut] for cut in range(1, n)]
        texts += [item[:2] + item[3:], item[: n // 2] + item[n // 2 + 1 :], [*item[:2], "x", *item[4:]], ["x", *item[2:]]]
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(benchmark):
            a, b = (Counter(tuple(t[at : at + 5]) for at in range(len(t) - 4)) for t in (text, item))
            m, total = sum(b.values()), sum(a.values())
            if 0 < total <= m and (s := sum((a & b).values())) >= 0.8 * (total + m - s):
                want[d, i] = (0, len(text), round(s / (total + m - s), 9))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(benchmark)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in decontaminate.find(docs, items).collect()}
    assert got == want and sum(len(texts[d]) < len(benchmark[i]) for d, i in want) > 20
    kept = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_several_anchor_tables_agree_with_one(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows(decontaminate.find(docs, items).toPandas())
    anchors = spark.range(100).selectExpr("id as h", "1 as most")
    monkeypatch.setattr(decontaminate, "TABLE_ROWS", 40)
    assert len(list(decontaminate._tables(anchors))) == 3
    monkeypatch.setattr(decontaminate, "TABLE_ROWS", 2000)
    assert rows(decontaminate.find(docs, items).toPandas()) == want and want


def decontaminated_rows(spark, ids):
    """20 items; of each, one text holds it whole and one its first 20 words. ``ids`` names the rows."""
    rng = np.random.default_rng(19)
    items, texts = [], []
    for _ in range(20):
        item = [f"b{rng.integers(10**6)}" for _ in range(40)]
        items.append(" ".join(item))
        texts += [" ".join(item + [f"d{rng.integers(10**6)}" for _ in range(60)]), " ".join(item[:20] + [f"d{rng.integers(10**6)}" for _ in range(60)])]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), texts


@pytest.mark.parametrize("ids", [list(range(40)), [i // 2 for i in range(40)], [None] * 40])
def test_decontamination_tells_rows_apart_by_text(spark, ids):
    docs, items, texts = decontaminated_rows(spark, ids)
    found = decontaminate.find(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == sorted((str(i), n // 2) for n, i in enumerate(ids) if n % 2 == 0)
    assert sorted(r["text"] for r in decontaminate.clean(docs.unionByName(docs), items).collect()) == sorted(texts[1::2] * 2)


def test_items_tell_apart_by_text(spark):
    docs, items, _ = decontaminated_rows(spark, range(40))
    for item_id in (None, 7):
        got = decontaminate.find(docs, items.withColumn("item_id", F.lit(item_id).cast("long"))).collect()
        assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in got) == [(n, item_id, 1.0) for n in range(0, 40, 2)]


def test_fingerprints_of_many_shingles(spark):
    """Both widths of lanes against the plain definition."""
    rng = np.random.default_rng(20)
    small, large = (rng.integers(-(1 << 63), 1 << 63, n) for n in (37, 70_000))
    large[:40_000] = large[0]
    df = spark.createDataFrame([(0, small.tolist()), (1, large.tolist())], "k int, h array<long>")
    got = {r["k"]: (r["fp"], r["narrow"]) for r in df.select("k", decontaminate.fingerprint("h").alias("fp"), decontaminate._counted("h", 2).alias("narrow")).collect()}
    want = [simhash.signed(simhash.fold_bits(x.view(np.uint64))) for x in (small, large)]
    assert [got[0], got[1]] == [(w, w) for w in want]


# Shared plumbing -----------------------------------------------------------------------------------


def test_split_by_keys(spark, odd):
    clear, maybe = split_by_keys(odd, F.col("doc_id"), spark.createDataFrame([(4,), (None,)], "k long"))
    assert clear.columns == maybe.columns == odd.columns
    assert {r["doc_id"] for r in maybe.collect()} >= {4, None} and clear.count() + maybe.count() == len(ODD)
    left = drop_ids(odd, "doc_id", spark.createDataFrame([(4,), (99,)], "k long"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in ODD if i != 4)
