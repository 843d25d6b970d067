"""Toxicity, chat formatting, embeddings and the pipeline."""

from __future__ import annotations

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from finlattice.llm import chat_format, embedding_dedup, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.01"


def test_what_one_machine_writes_the_next_one_reads():
    r = random.Random(6)
    for one, two in ((toxicity.marker((5,), (1, 2), 16, 4), toxicity.marker((3, 4), (1,), 8, 6)), (toxicity.marker((6,), (1, 2), 32, None), toxicity.Transducer({(0, 1 | 32): (1, 0), (1, 1 | 32): (0, 2)}))):
        both = one.then(two)
        for _ in range(200):
            tape = [r.choice(toxicity.SYMBOLS) for _ in range(r.randrange(30))]
            assert both.run(tape) == two.run(one.run(tape))


def twin(text, lexicon):
    lists = (toxicity.THREATS, toxicity.OBJECTS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS)
    return brute.toxic_evidence(text, lexicon, lists, toxicity.MARKS, (toxicity.THREAT_WEIGHT, toxicity.FULL, toxicity.BARE, toxicity.UNDER_NEGATION, toxicity.UNDER_REPORT))


def test_evidence_against_a_plain_scorer(spark):
    r = random.Random(7)
    lexicon = {"fool": 2.0, "scum": 4.5, "of": 1.5}
    words = [*lexicon, "kill", "beat", "you", "him", "dich", "not", "never", "said", "a", "b", "c", "d", "the", ",", "-", "|", "Fool!", "YOU,", "kill.", "(scum)", "x:"]
    texts = [r.choice([" ", "  ", "\t"]).join(r.choice(words) for _ in range(r.randrange(25))) + r.choice(["", "\n", "\r\n"]) + " ".join(r.choice(words) for _ in range(r.randrange(9))) for _ in range(3000)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", None, "you fool " * 20000]
    reader = toxicity.Reader(lexicon)
    hits = 0
    for t in texts:
        want = twin(t, lexicon)
        assert np.allclose(np.expm1(reader.evidence(t or "")), want), t
        hits += want[0] > 0
    assert hits > 1000


def test_registered_query_against_a_plain_scorer(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, folder).collect()}
    for r in docs.collect():
        z = model.weights[0] + np.log1p(twin(r.text, model.lexicon)) @ np.array(model.weights[1:])
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_clause_patterns(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: float(model.score(np.array([toxicity.Reader(model.lexicon).evidence(t)]))[0])
    clean = ["More trains closed this morning.", "Please close the tab and transfer more trade data tomorrow morning.", "The moral of the travel story is clear.", "Das Wort ist gut.", "kill the process", "idiot , he said"]
    clean += ["We will not kill you.", "you are not an idiot", "The film did not kill the mood for you", "Il tue les mouches.", "Gut, du kommst.", ""]
    toxic = ["kill you", "I will kill all of you", "Ich werde dich töten!", "you idiot", "idiot you", "They are scum and you are trash"]
    assert [t for t in clean if score(t) >= 0.5] == [] and [t for t in toxic if score(t) < 0.5] == []
    assert score("you idiot") > score("idiot") > score("idiot , he said") and score("not. an idiot") > score("not an idiot")


def test_clashing_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "you fool", "a", 1.0, 2), (1, "you fool", "a", 1.0, 2), (None, None, "b", 1.0, 2)], "doc_id long, text string, label string, e0 double, score int")
    model = toxicity.Model({"fool": 5.0}, [-3.0, 2.0, 2.0, 0.0])
    assert toxicity.score(docs, model).count() == 3 and toxicity.without_toxic(docs, model).collect() == [(None, None, "b", 1.0, 2)]
    labels = spark.createDataFrame([(2, 1, "x"), (3, 0, "y"), (None, 1, "z"), (3, None, "z")], "doc_id long, toxic int, text string")
    assert toxicity.fit(docs.limit(0), labels).lexicon == {} and toxicity.fit(docs, labels).lexicon == {}


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[x.doc_id].predicted, x.toxic) for x in labels if got[x.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.95


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "fool"), (2, "fool " * 50000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert sorted(r.score for r in toxicity.score(docs, model).collect())[-1] < 0.01
    model = toxicity.Model({"fool": 5.0}, [-3.0, 2.0, 2.0, 0.0])
    assert sorted(r.score > 0.5 for r in toxicity.score(docs, model).collect()) == [False, False, True, True]
    assert toxicity.without_toxic(docs, model).count() == 2


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "user", "\\1 \\\\0 <s>"), (1, 2, "assistant", odd + "\\"), (1, 3, "assistant", ""), (2, 0, None, None), (3, 1, "assistant", "b"), (3, 0, "system", "é🎉"), (3, 1, "assistant", "b"), (3, None, "user", "[/INST][INST]"), (None, 0, "we[INST]ird", "x")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = chat_format.read_chats(chat_format.format_chats(turns)).collect()
    want: dict = {}
    for c, n, role, text in rows:
        want.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        mine = sorted(want[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in mine]
        assert r.learned == "".join(t[2] for t in mine if t[1] == "assistant")
    assert chat_format.format_chats(turns.limit(0)).count() == 0
    merged = {r.conv_id: r.formatted for r in chat_format.format_chats(turns).collect()}
    assert merged[3] == "<s>user[INST]\\4\\3[/INST]</s><s>system[INST]é🎉[/INST]</s><s>assistant[INST]b[/INST][INST]b[/INST]</s>"


def test_embeddings(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    v = [x + r.normal(size=16) * s for x in base for s in (0.0, 0.05, 0.12, 0.2)] + [base[0], base[0], base[1] * 3]
    rows = [(k, [float(y) for y in x], 0) for k, x in enumerate(v)]
    bad = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] + [1.0] * 15, 1), (504, [float("inf")] + [1.0] * 15, 1), (505, [None] + [1.0] * 15, 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (508, [-0.0] * 16, 1)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows + bad], "vec_id long, embedding array<double>, label int, node string, copies int")
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df).collect()}
    ok = {k: np.array(x) for k, x, _ in rows} | {506: np.array([1.0, 2.0]), 507: np.array([1.0, 2.0])}
    linked = lambda a, b: len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9
    of = brute.classes(ok, linked)
    for k in ok:
        assert got[k].n_links == sum(linked(k, j) for j in ok if j != k) and got[k].component_id == of[k] and got[k].kept == (of[k] == k)
    for k, *_ in bad:
        if k not in ok:
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SIDE", 40)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 160")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(df).collect()}
    v = {x.vec_id: np.array(x.embedding) for x in df.collect()}
    linked = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.9
    of = brute.classes(v, linked)
    assert got == {k: (sum(linked(k, j) for j in v if j != k), of[k]) for k in v}


def test_extreme_norms_keep_their_links(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=8)
    rows = [(k, [float(x) for x in a * s + (r.normal(size=8) * 1e-3 * s)]) for k, s in enumerate((1.0, 1e160, 1e-170, 1e300))] + [(9, [float(x) for x in -a])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 9: (0, 9)}


def test_quantisation_bound_holds():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(50, 64)), r.normal(size=(60, 64))
    a, b = embedding_dedup.Quantised(x), embedding_dedup.Quantised(y)
    assert a.steps.dtype == np.int8
    near = (a.steps.astype(float) @ b.steps.T.astype(float)) * a.scale[:, None] * b.scale
    exact = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (np.abs(near - exact) <= a.length[:, None] * b.error + a.error[:, None] + 1e-12).all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        out = stage(spark, kept, DATA)
        if name == "packing":
            tokens = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
            assert {r.doc_id for r in tokens} == set(before) and all(r.n == r.t for r in tokens)
            break
        assert out.columns == columns
        rows = [tuple(r) for r in out.collect()]
        kept = spark.createDataFrame(rows, docs.schema)
        after = {r[0]: r[1] for r in rows}
        assert set(after) <= set(before) and len(after) == len(rows)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
            assert set(after) == {i for i in before if score[i] < 0.5}
        elif name == "exact dedup":
            best: dict = {}
            for i, t in before.items():
                best[t] = max(i, best.get(t, i))
            assert set(after) == set(best.values())
        elif name == "simhash near-dedup":
            fp = {i: brute.simhash(t) for i, t in before.items()}
            of = brute.classes(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
            low: dict = {}
            for i, f in fp.items():
                low[of[f]] = min(i, low.get(of[f], i))
            assert set(after) == set(low.values())
        elif name == "secret scans":
            assert set(after) == set(before) and all((after[i] == texts[i]) == (not brute.secrets(texts[i])) for i in after)
            assert not any(brute.secrets(t) for t in after.values())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns, an empty table, a very long row; tables made on the way go."""
    rows = [(None, None, "a"), (None, "", "b"), (1, "one two three", "c"), (1, "one two three", "c"), (2, "x" + " " * 10**6 + "y token=abcdefgh1", "d"), (None, "four five six seven", "e")]
    frame = spark.createDataFrame([(i, t, c, 1, 2) for i, t, c in rows], "doc_id long, text string, row string, th int, blob int")
    folder = str(tmp_path)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.doc_tokens) for r in out} >= {(None, 1), (1, 4)} and sum(r.length for r in out) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in out}.values())
    assert {r.doc_id for r in out} == {None, 1, 2}
    none = str(tmp_path / "none")
    frame.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_tables_on_the_way_are_removed(spark):
    import os

    from finlattice.llm import _common

    with _common.scratch() as made:
        _, path = _common.written(spark.range(3).toDF("a"), "x")
    assert made == [path] and os.path.exists(path.removeprefix("file:"))
    _common.removed(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_substring_dedup", "op6_chat", "op7_exact_dedup", "op9_embeddings"])
def test_queries_match_sql(spark, name):
    import duckdb

    from finlattice.llm import registry

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, folder)
    want = con.sql(registry.ORACLE[name])
    rows = sorted(map(repr, (tuple(r[c] for c in got.columns) for r in got.collect())))
    order = [want.columns.index(c) for c in got.columns]
    assert rows == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def registered(spark, name, *columns):
    from finlattice.llm import registry

    return sorted(tuple(r) for r in registry.QUERIES[name](spark, SMALL).select(*columns).collect())


def test_registered_passages_over_a_whole_table(spark, whole):
    assert registered(spark, "op1_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.byte_repeats(whole))
    assert registered(spark, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.word_repeats(whole))


def test_registered_tokens_over_a_whole_table(spark, whole):
    import public_tokenizers
    from tokenizers import Tokenizer

    words, pieces = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    want = []
    for i, t in whole:
        ids = words.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(words.decode(ids, skip_special_tokens=False))))
    assert registered(spark, "op4_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    ids = {i: np.array([*pieces.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in whole}
    got = registered(spark, "op5_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    reach: dict = {}
    for i, start, n, crc, total, _, _ in got:
        assert start == reach.get(i, 0) and crc == zlib.crc32(ids[i][start : start + n].tobytes()) and total == len(ids[i])
        reach[i] = start + n
    assert reach == {i: len(x) for i, x in ids.items()}
    filled: dict = {}
    for *_, n, _, _, s, at in sorted(got, key=lambda p: (p[5], p[6])):
        assert at == filled.get(s, 0)
        filled[s] = at + n
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_registered_secrets_and_fingerprints_over_a_whole_table(spark, whole):
    names = ("assign", "access", "hex")
    want = []
    for i, t in whole:
        found = brute.secrets(t)
        want.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), brute.sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found))))
    assert registered(spark, "op8_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    fp = {i: brute.simhash(t) for i, t in whole}
    of = brute.classes(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    low: dict = {}
    for i, f in fp.items():
        low[of[f]] = min(i, low.get(of[f], i))
    assert registered(spark, "op10_simhash", "doc_id", "fingerprint", "component_id") == sorted((i, f"{f:016x}", low[of[f]]) for i, f in fp.items())
