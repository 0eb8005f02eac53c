import math
import re
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import ann, mixing, preference, pu_learning, quality, queries, toxicity, transport_stream

SF = "/root/testdata/sf0.01"


def accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), len(rows)


def test_quality_and_toxicity_on_held_out_labels(spark):
    right, n = accuracy(spark, queries.op3_quality(spark, SF), "quality")
    assert n > 50 and right >= 0.95
    right, n = accuracy(spark, queries.op4_toxicity(spark, SF), "toxic")
    assert n > 50 and right >= 0.9


def test_risk_finds_positives_among_unlabelled():
    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (400, 3))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (300, 3)), rng.normal(-1.5, 1, (700, 3))])
    w, b = pu_learning.fit(pu_learning.Sparse.of_dense(positive), pu_learning.Sparse.of_dense(unlabelled), 0.3)
    score = pu_learning.logistic(unlabelled @ w + b)
    assert (score[:300] > 0.5).mean() > 0.9 and (score[300:] < 0.5).mean() > 0.9
    w, b = pu_learning.fit(pu_learning.Sparse.of_dense(positive[:0]), pu_learning.Sparse.of_dense(unlabelled), 0.3)
    assert abs(pu_learning.logistic(b) - 0.3) < 1e-9 and not w.any()


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Some words.", 2), (None, None, 2), (2, "", None), (2, "", None), (3, "x" * 100000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    for scored in (quality.with_quality(docs, labels), toxicity.with_toxicity(docs, labels), quality.with_quality(docs, labels.limit(0)), toxicity.with_toxicity(docs.limit(0), labels)):
        assert all(0 <= r["score"] <= 1 for r in scored.collect())


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 8)) + 3 * rng.normal(size=(12, 8))[rng.integers(0, 12, 3000)]
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [1.0, None] * 4), (5080, [1.0]), (None, [1.0] * 8)]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        assert len(by[q]) == 20 and all(abs(x - v[i] @ v[q]) < 1e-9 for i, x in by[q])
        hits.append(len({i for i, _ in by[q]} & set(best.tolist())) / 20)
    assert by.keys() == set(range(0, 3000, 20)) and np.mean(hits) >= 0.9
    copies = [i for i, _ in by[200]]
    assert copies == sorted(copies) or v[100] @ v[100] < max(s for _, s in by[200])


def test_vectors_without_clusters(spark):
    v = np.random.default_rng(4).normal(size=(4000, 12))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = ann.neighbours(rows, F.col("vec_id") % 20 == 0).collect()
    assert len(found) == 200 * 20 and all(abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < 1e-9 for r in found)
    hits, by = 0, {}
    for r in found:
        by.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 4000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        assert sorted(by[q]) == list(range(1, 21)) and all(s[by[q][i]] >= s[by[q][i + 1]] for i in range(1, 20))
        hits += len(set(by[q].values()) & set(np.argsort(-s)[:20].tolist()))
    assert hits / 4000 >= 0.95 and found[0]["recall"] >= 0.97


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    found = ann.neighbours(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert ann.neighbours(few.limit(0), F.lit(True)).count() == 0


def test_transport_streams_round_trip(spark):
    rng = np.random.default_rng(2)
    for n in [*range(0, 800, 9), *range(165, 190), 8183, 8184, 8192, 8193, 50000]:
        data = rng.bytes(n)
        stream = transport_stream.demux(transport_stream.mux(data))
        assert (stream.payload, stream.error, stream.discontinuities) == (data, None, 0)
        assert stream.stamps == [3600 * k for k in range(-(-n // 8192))] and len(stream.random_access) == -(-n // (4 * 8192))
    broken = bytearray(transport_stream.mux(rng.bytes(60000)))
    del broken[188 * 9 : 188 * 10]
    assert transport_stream.demux(bytes(broken)).discontinuities == 1 and transport_stream.demux(b"\x47" + b"\0" * 187).error
    assert transport_stream.crc32_mpeg(b"123456789") == 0x0376E6E7
    rows = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "é" * 50000, "m"), (3, "x", None)], "doc_id long, text string, media string")
    read = transport_stream.load(transport_stream.store(rows)).orderBy("doc_id", "text").collect()
    assert [len(r["stream"]["payload"]) for r in read] == [64, 64, 64, 100032] and read[3]["stream"]["payload"].startswith("é".encode())
    assert transport_stream.load(spark.createDataFrame([(None,)], "media binary")).first()["stream"]["error"] == "no stream"


def test_preferences_match_sql(spark):
    found = queries.op8_preference(spark, SF)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    result = db.execute(preference.ORACLE_SQL)
    names = [d[0] for d in result.description]
    columns = sorted(found.columns)
    assert sorted(names) == columns
    assert sorted(tuple(map(str, r)) for r in found.select(*columns).collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_endings_of_odd_conversations_match_sql(spark):
    rows = [
        (-2, 0, "user", "a"), (-2, 1, "assistant", "b"), (-1, 0, "user", "a"), (-1, 1, "assistant", "c"), (-1, 1, "assistant", "c"),
        (6, 0, "user", "alone"), (6, 1, None, "last"), (8, None, "user", "no turn"), (8, 0, "assistant", None), (None, 0, "user", "nobody's"), (0, 0, "user", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = preference.preference_pairs(*preference.with_other_endings(turns)).drop("chosen_mask", "rejected_mask")
    db = duckdb.connect()
    db.register("conversations", turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = sorted(pairs.columns)
    expected = db.execute(f"SELECT {', '.join(columns)} FROM ({preference.ORACLE_SQL})").fetchall()
    assert sorted(tuple(map(str, r)) for r in pairs.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in expected) and len(expected) == 5


def test_preference_masks_and_missing_sides(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, None, "x"), (None, 0, "user", "y")]
    rows = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, pair_id int")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 3, None), (4, 9, 8)], "pair_id long, chosen long, rejected long")
    found = {r["pair_id"]: r for r in preference.preference_pairs(rows, pairs).collect()}
    first = found[1]
    assert first["prefix_turns"] == 1 and first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [first["chosen"][m["start"] : m["end"]] for m in first["chosen_mask"]] == ["yes<|im_end|>\n"]
    assert found[2]["chosen"] == "" == found[2]["rejected"] and found[2]["prefix_turns"] == 2
    assert found[3]["prefix_turns"] == 0 and found[3]["rejected"] == "" and found[4]["prompt"] == ""


def test_rates_meet_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mixer, rated = mixing.fit(docs, queries.labelled_domains(spark, SF), queries.TARGETS)
    rows = rated.collect()
    n = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in mixer.domains] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    share = (n * rate) @ p / n.sum()
    assert np.allclose(share, [queries.TARGETS[d] for d in mixer.domains], rtol=0.02)
    again = np.ones(len(rows))  # the same descent in numpy
    for errors in mixer.turns:
        again = np.maximum(0, again - mixer.step * (p @ np.array(errors) + mixing.PULL * (again - 1)))
    assert np.allclose(again, rate, atol=1e-5)
    assert [len(r["text"].split()) for r in docs.limit(20).collect()] == [r["n_tokens"] for r in mixing.with_rates(docs.limit(20), mixer).collect()]


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0), (None, None, 2.0), (2, "", None), (2, "", None)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "id long, domain string")
    mixer, rated = mixing.fit(docs, none, {"x": 1, "y": 1})
    assert rated.count() == 4 and {r["p_x"] for r in rated.collect()} == {0.5}
    assert mixing.mixed(docs, mixer).columns == docs.columns
    assert mixing.fit(docs.limit(0), none, {"x": 1, "y": 1})[1].count() == 0


def test_rates_end_at_the_optimum_where_a_target_is_out_of_reach(spark):
    few, many = "rust rot ruin", "clear plain words that say what they mean"
    rows = [(i, few if i < 2 else f"{many} {many}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "b" if i < 2 else "a") for i in range(0, 400)], "id long, domain string")
    targets = {"a": 0.2, "b": 0.8}
    with pytest.warns(UserWarning, match="relative errors"):
        mixer, rated = mixing.fit(docs, labels, targets)
    found = rated.collect()
    n = np.array([r["n_tokens"] for r in found], float)
    p = np.array([[r["p_a"], r["p_b"]] for r in found])
    rate = np.array([r["rate"] for r in found])
    wanted = np.array([0.2, 0.8]) * n.sum()
    left = (n * rate) @ p / wanted - 1
    assert np.allclose(mixer.errors, left, atol=1e-4) and np.abs(left).max() > mixing.MISSED
    # a step of the descent from the optimum changes nothing
    assert np.allclose(rate, np.maximum(0, 1 - p @ left / mixing.PULL), rtol=1e-3, atol=0.05)


def test_targets_that_cannot_be_meant_and_zero_targets(spark):
    rows = [(i, "clear plain words that say what they mean" if i % 2 else "rust rot ruin dirt dust") for i in range(200)]
    # extra columns whose names are used inside
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __n", "'x' AS __p", "2 AS __words", "3.5D AS rate")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "junk") for i in range(200)], "id long, domain string")
    for targets, why in (({}, "at least one"), ({"good": 0.0}, "zero"), ({"good": 1.0, "junk": -0.1}, "negative"), ({"good": float("nan")}, "finite")):
        with pytest.raises(ValueError, match=why):
            mixing.fit(docs, labels, targets)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        mixer, rated = mixing.fit(docs.select("doc_id", "text"), labels, {"good": 1.0, "junk": 0.0})
    found = rated.collect()
    n, rate = np.array([r["n_tokens"] for r in found], float), np.array([r["rate"] for r in found])
    p = np.array([[r["p_good"], r["p_junk"]] for r in found])
    share = (n * rate) @ p / n.sum()
    assert np.isfinite(mixer.errors).all() and np.isfinite(rate).all() and abs(share[0] - 1) < 0.02 and share[1] < 0.01
    assert np.allclose(mixer.errors, [share[0] - 1, share[1] / mixing.FLOOR], atol=1e-3)
    assert bool([w for w in said if "relative errors" in str(w.message)]) == (max(map(abs, mixer.errors)) > mixing.MISSED)
    out = mixing.mix(docs, labels, {"good": 0.5, "junk": 0.5})[1]
    assert out.columns == docs.columns and out.count() > 0


def test_posteriors_are_those_of_a_plain_naive_bayes(spark):
    """Counts, weights and posteriors in plain Python over Spark's hashes of the words' beginnings and endings."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120)
    labels = queries.labelled_domains(spark, SF)
    domains = sorted(queries.TARGETS)
    mixer = mixing._classifier(docs, labels, domains, "doc_id", "text")
    texts = {r["doc_id"]: [w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w] for r in docs.collect()}
    parts = sorted({(k, x) for ws in texts.values() for w in ws for k, x in (("a", w[:5]), ("b", w[-2:]))})
    hashed = spark.createDataFrame(parts, "k string, x string").selectExpr("k", "x", f"CASE k WHEN 'a' THEN pmod(xxhash64(x), {mixing.BUCKETS}) ELSE pmod(xxhash64('-', x), {mixing.BUCKETS}) END AS h").collect()
    bucket = {(r["k"], r["x"]): r["h"] for r in hashed}
    of = lambda ws: [bucket["a", w[:5]] for w in ws] + [bucket["b", w[-2:]] for w in ws]
    again = lambda ws: sum(a == b for a, b in zip(ws, ws[1:]))
    counts, repeats, shares, domain = {d: {} for d in domains}, {d: [1, 1] for d in domains}, dict.fromkeys(domains, 0), {}
    for r in labels.collect():
        if r["domain"] is not None and r["id"] in texts:
            domain[r["id"]] = min(domain.get(r["id"], r["domain"]), r["domain"])
    known = {r["id"]: r["domain"] for r in labels.where("domain is not null").groupBy("id").agg(F.min("domain").alias("domain")).collect()}
    for d in known.values():
        shares[d] += 1
    for i, d in domain.items():
        for b in of(texts[i]):
            counts[d][b] = counts[d].get(b, 0) + 1
        repeats[d][0] += again(texts[i])
        repeats[d][1] += len(texts[i]) - again(texts[i])
    totals = {d: sum(counts[d].values()) + mixing.BUCKETS for d in domains}
    log = lambda d, b: math.log((counts[d].get(b, 0) + 1) / totals[d])
    for r in mixing.with_rates(docs, mixer).collect():
        ws = texts[r["doc_id"]]
        scale = math.sqrt(max(len(ws), 1))
        z = []
        for d in domains:
            likely = sum(log(d, b) - sum(log(o, b) for o in domains) / len(domains) for b in of(ws))
            yes, no = (math.log(x / sum(repeats[d])) for x in repeats[d])
            z.append((likely + again(ws) * yes + (len(ws) - again(ws)) * no) / scale + math.log((shares[d] + 1) / (sum(shares.values()) + len(domains))))
        e = np.exp(np.array(z) - max(z))
        assert np.allclose([r[f"p_{d}"] for d in mixer.domains], e / e.sum(), rtol=1e-4, atol=1e-7)
