"""The operators over DataFrames: edge cases, brute force, contracts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from selenite.llm import bpe, cdc, crf, ego_join, html_blocks, licenses, minhash, ppm, sharding, simhash, tiling
from selenite.llm.common import components
from tests.conftest import SF
from tests.llm.test_methods import ppm_score

PASSAGE = " ".join(f"word{i} of the passage" for i in range(16))
TEXTS = [
    (1, "Alpha beta gamma delta. " + PASSAGE + " End one."),
    (2, "Quite another start here; " + PASSAGE + " and another end."),
    (3, None), (4, ""), (None, "no id at all here"), (5, "all rights reserved, CC BY 4.0"), (5, "all rights reserved, CC BY 4.0"),
    (6, "x" * 5000), (7, "Größe éa ñandú  \n tabs\tand lines"), (8, "all rights reserved, CC BY 4.0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_bpe_round_trip(docs, empty):
    handle = bpe.prepare(docs, corpus_pipeline.VOCABULARY, lexicon_words=5)
    coded = bpe.encode(docs, handle, keep=["doc_id", "text"], decoded=True)
    again = bpe.decode(coded.withColumnRenamed("decoded", "first"), handle, keep=["doc_id", "first"]).withColumnRenamed("decoded", "second").collect()
    assert bpe.decode(coded, handle, keep=["ids", "decoded"]).columns == ["ids", "decoded"]
    assert len(again) == len(TEXTS) and all(r.first == r.second for r in again)
    assert [len(r.ids) for r in coded.where("text is null or text = ''").collect()] == [0, 0]
    assert bpe.encode(empty, bpe.prepare(empty, corpus_pipeline.VOCABULARY)).count() == 0


def test_ppm(docs, empty):
    rows = ppm.score(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.score < 0 and r.base_score < 0 for r in rows)
    train = [(i, t or "") for i, t in TEXTS if i is None or zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for _, t in train for w in t.encode().lower().split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    for r in rows:
        assert r.train_tokens == n
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    by_id = {r.doc_id: r for r in rows}
    for i, t in TEXTS:
        tokens = (t or "").encode().lower().split()
        base = sum(np.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(words[w] for w in tokens), len(train)])
        assert by_id[i].base_score == pytest.approx(base) and by_id[i].n_tokens == len(tokens) + 1
    assert ppm.score(empty).count() == 0


def test_ppm_scores_of_whole_texts_equal_a_trie(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(ppm, "PIECE_BYTES", 100)
    texts = [
        "The cat sat on the mat and the cat ran", "the cat sat on the mat and the dog ran", "A  dog\nsat on the mat and the cat slept", "", None,
        "the cat sat on the mat and the cat ran", "Größe und ñandú on the mat and the", "the cat sat on the mat and the cat ran",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(3)
    train = [ppm.coded((t or "").encode()) for i, t in enumerate(texts * 3) if zlib.crc32(str(i).encode()) % 10]
    rows = ppm.score(docs).collect()
    assert {r.held_out for r in rows} == {True, False} and len(rows) == 24
    for r in rows:
        assert r.score == pytest.approx(ppm_score(train, ppm.coded((texts[r.doc_id % 8] or "").encode())))


def test_passages_are_cut_from_later_texts(docs, empty):
    out = {(r.doc_id, r.text) for r in cdc.remove_spans(docs).collect()}
    assert cdc.remove_spans(docs).columns == docs.columns and cdc.remove_spans(docs).count() == len(TEXTS)
    assert (1, TEXTS[0][1]) in out
    second = next(t for i, t in out if i == 2)
    assert second.startswith("Quite another start here; ") and second.endswith(" end.") and len(second) < 220
    assert (3, None) in out and (4, "") in out and (None, "no id at all here") in out
    assert cdc.remove_spans(empty).count() == 0


def plain_spans(rows):
    """What ``duplicate_spans`` finds, in one process."""
    found = {}
    for i, t in dict.fromkeys((i, t) for i, t in rows if t):
        raw = t.encode()
        ends = cdc.cuts(raw)
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            found.setdefault(raw[a:b], []).append((i, t, k, a, b))
    later = {}
    for piece, own in found.items():
        least = min(own, key=lambda x: (x[0], key_of(x[1]), x[2]))
        for x in own:
            if x is not least:
                later.setdefault((x[0], x[1]), []).append((*x[3:], len(piece.split()), len(piece.decode())))
    out = {}
    for doc, pieces in later.items():
        runs = []
        for a, b, w, n in sorted(pieces):
            if runs and runs[-1][1] == a:
                runs[-1] = (runs[-1][0], b, runs[-1][2] + w, runs[-1][3] + n)
            else:
                runs.append((a, b, w, n))
        if runs := [[a, b] for a, b, w, n in runs if w >= cdc.MIN_WORDS or n >= cdc.MIN_CHARACTERS]:
            out[doc] = runs
    return out


def key_of(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def test_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.where("doc_id % 40 = 0").withColumn("doc_id", F.col("doc_id") + 100000))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text_of = {(i, int(key_of(t))): t for i, t in rows if t}
    got = {(r.id, text_of[r.id, r.text_key]): r.spans for r in cdc.duplicate_spans(docs).collect()}
    assert got and got == plain_spans(rows)


def test_texts_without_blanks_are_cut(spark):
    shared = "".join(chr(0x4E00 + (i * i * 31 + i * 7) % 20000) for i in range(2600))
    odd = "".join(chr(0xAC00 + (i * i * 17 + i) % 11000) for i in range(300))
    rows = [(1, shared, "a"), (2, odd + shared + odd[::-1], "b"), (3, "a" * 9000, "c"), (4, None, "d"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in cdc.remove_spans(docs).collect()}
    assert got[1].text == shared and 600 <= len(got[2].text) < 1000 and got[2].text.startswith(odd)
    assert (got[4].text, got[5].text) == (None, "") and [got[i].spans for i in range(1, 6)] == list("abcde")
    assert len(got[3].text) < 9000  # its own chunks repeat


def test_one_hot_passage_is_dealt_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(PASSAGE + " tail "), F.col("id").cast("string")).alias("text"))
    assert cdc.duplicate_spans(docs).count() == 399


def test_shards_are_exact(spark, docs, empty):
    rows = docs.select("doc_id", F.length("text").alias("size"))
    got = sharding.shuffle(rows, 4, target_rows=2).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    assert sharding.shuffle(rows.where("false"), 4).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(1, None), (1, "<article><p>a b</p></article>"), (None, "")], "id int, html string")
    assert sorted(r.text for r in html_blocks.extract(rows, keep=["id"]).collect()) == ["", "", "a b"]


def plain_components(marks, distance):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def test_simhash_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    near = rows.limit(30).select((F.col("doc_id") + 100000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"))
    rows = rows.unionByName(near).cache()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(simhash.fingerprints(rows, keep=["doc_id"]), "doc_id").collect()}
    listed = sorted(rows.collect())
    marks = []
    for r in listed:
        w = r.text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        marks.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert [got[r.doc_id][0] & (2**64 - 1) for r in listed] == marks
    assert [got[r.doc_id][1] for r in listed] == [listed[i].doc_id for i in plain_components(marks, 4)]


def test_large_groups_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = np.random.default_rng(1)
    marks = sorted({int(np.bitwise_xor.reduce([1 << int(b) for b in rng.choice(60, 2)])) for _ in range(60)} | {1 << 61})
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    found = {(r.u, r.v) for r in simhash.links(df, 4).collect()}
    root = {r.node: r.root for r in components(spark.createDataFrame(list(found), "u long, v long")).collect()}
    assert [root.get(m, m) for m in marks] == [marks[i] for i in plain_components(marks, 4)]


def test_one_of_a_group_stays(docs, empty):
    kept = simhash.keep_first(docs).collect()
    assert [r.doc_id for r in kept if r.text and r.text.startswith("all rights")] == [5]
    assert simhash.keep_first(docs).columns == docs.columns and simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("shingles", [400_000, 500])
def test_copies_at_jaccard_are_linked(spark, empty, monkeypatch, shingles):
    monkeypatch.setattr(minhash, "PART_SHINGLES", shingles)  # 500: groups of several parts
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 100_000, n)]
    texts = []
    for _ in range(12):
        base = word(200)
        texts.append(base)
        for changes in (1, 3, 4, 8):  # similarities of about 0.95, 0.86, 0.82 and 0.66
            near = list(base)
            for at in rng.choice(np.arange(3, 197, 6), changes, replace=False):
                near[at] = "changed"
            texts.append(near)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root] if root[j] < root[i] else [root[i] if r == root[j] else r for r in root]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(rows, jaccard=0.8).collect()} == set(root)
    assert simhash.keep_first(empty, jaccard=0.8).count() == 0


def test_licences(spark, docs, empty):
    got = {r.doc_id: r.f for r in docs.select("doc_id", licenses.scan(F.col("text")).alias("f")).collect()}
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (7, 2, 0, 3, "cc-by,reserved")
    assert got[5].labels == "all-rights-reserved,cc-by,cc-by-4.0,reserved" and 0 < got[5].score <= 1
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "SPDX-License-Identifier: MIT": "mit",
        "the GNU General Public License, version 3, or any later version": "gpl,gpl-3-or-later",
        "MIT " * 3000 + "License": "mit",
        "the BSD 3-Clause license and the Mozilla Public License 2.0": "bsd-3-clause,mpl-2.0",
        "nothing of the kind": "",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3-or-later",
        "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2.0,mit",
        "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-2.0 AND ISC) or not": "classpath-exception-2.0,gpl-2-only,isc,mpl-2.0",
        "spdx license identifier of no kind": "",
        "the GPL 2.0 only, SPDX-License-Identifier: CC-BY-SA-4.0 and LGPL-2.1+": "cc-by,cc-by-sa-4.0,gpl-2-only,lgpl-2.1-or-later",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", licenses.scan(F.col("t"))["labels"].alias("l"))
    assert {r.t: r.l for r in rows.collect()} == cases


def test_licences_by_their_only_sign(spark):
    cases = {
        "as is without warranty": "as-is",
        "as is, without any warranties": "as-is",
        "library general public license": "gpl,lgpl",
        "the beerware license": "beerware",
        "the beer-ware licence": "beerware",
        "general public license version 3": "gpl,gpl-3",
        "GNU General Public License 2 or (at your option) any later version": "gpl,gpl-2-or-later",
        "released under the GPL v3": "gpl-3",
        "LGPL 2.1": "lgpl-2.1",
        "AGPL-3.0": "agpl-3",
        "3-clause BSD": "bsd-3-clause",
        "CDDL 1.0": "cddl-1.0",
        "CeCILL": "cecill",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", licenses.scan(F.col("t"))["labels"].alias("l"))
    assert {r.t: r.l for r in rows.collect()} == cases


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11)}
    assert ego_join.near_vectors(df.where("false")).count() == 0


def test_tiling_over_tables(spark, docs, empty):
    bench = spark.createDataFrame([(9, "of the passage word4 of the passage"), (10, None), (11, "")], "item_id long, text string")
    got = {r.doc_id: (r.coverage, r.item_id) for r in tiling.coverage(docs, bench, keep=["doc_id"]).collect()}
    assert got[1] == got[2] == (1.0, 9) and got[3] == got[4] == (0.0, None)
    assert {r.doc_id for r in tiling.clean(docs, bench).collect()} == {None, 3, 4, 5, 6, 7, 8}
    assert tiling.clean(docs, bench).columns == docs.columns
    assert tiling.clean(docs, bench.where("false")).count() == len(TEXTS) and tiling.clean(empty, bench).count() == 0


def test_blocks_of_the_benchmark_agree(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["of the passage word4 of the passage", "all rights reserved cc by", "zz"])], "item_id long, text string")
    one = sorted(map(tuple, tiling.coverage(docs, bench, keep=["text"]).collect()), key=str)
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 20)
    assert sorted(map(tuple, tiling.coverage(docs, bench, keep=["text"]).collect()), key=str) == one


def test_short_spellings_of_licenses(spark):
    cases = {
        "GPLv3": "gpl-3", "This is GPLv2+ code": "gpl-2-or-later", "under GPL-3.0+": "gpl-3-or-later", "LGPLv2.1+": "lgpl-2.1-or-later", "AGPLv3": "agpl-3",
        "MPL-2.0": "mpl-2.0", "MPL 2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "licensed under MIT": "mit", "Licensed under Apache 2.0": "apache-2.0",
        "Apache-2.0": "apache-2.0", "released under the MIT": "mit", "SPDX-License-Identifier: GPL-2.0+": "gpl-2-or-later", "SPDX-License-Identifier: GPL-2.0": "gpl-2",
        "dual licensed under the GPLv2 and the MPL 1.1": "gpl-2,mpl-1.1", "a simple example of a template": "", "the EPL 2 season": "", "C+ and 3+4": "", "mit der Zeit": "",
        "distributed under the terms of the zlib": "zlib", "all rights reserved, GPLv2+": "all-rights-reserved,gpl-2-or-later,reserved",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", licenses.scan(F.col("t")).alias("f")).collect()
    assert {r.t: r.f.labels for r in rows} == cases
    assert next(r.f for r in rows if r.t.startswith("all rights"))[:4] == (4, 1, 0, 0)


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = crf.score(docs, crf.fit(docs, labels), keep=["doc_id"]).where(crf.held_out()).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in scored]) > 0.95
    assert crf.score(docs.where("false"), {"constant": 0.5}).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (7, 7), (50, 40)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 40: 30, 50: 30}
    assert components(edges.where("false")).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, rows = docs.schema, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in schema]
        rows = spark.createDataFrame(rows.collect(), schema)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert 0 < last.count() == rows.count() < docs.count()
    assert isinstance(last.schema["ids"].dataType, T.BinaryType)


def test_columns_of_the_results_names_give_way(spark, docs):
    rows = docs.withColumns({c: F.lit("old") for c in ("ids", "decoded", "fingerprint", "component_id", "shard", "slot", "score", "coverage", "item_id", "spans", "root", "node")})
    bench = spark.createDataFrame([(9, "of the passage word4 of the passage")], "item_id long, text string")
    handle = bpe.prepare(docs, corpus_pipeline.VOCABULARY, lexicon_words=5)
    every = rows.columns
    results = [
        (bpe.encode(rows, handle, keep=every, decoded=True), ["ids", "decoded"]),
        (simhash.fingerprints(rows, keep=every), ["fingerprint"]),
        (simhash.near_duplicates(simhash.fingerprints(rows, keep=every), "doc_id"), ["fingerprint", "component_id"]),
        (sharding.shuffle(rows, 4), ["shard", "slot"]),
        (html_blocks.extract(rows, "text", keep=every), ["text"]),
        (crf.score(rows, {"constant": 0.5}, keep=every), ["score"]),
        (tiling.coverage(rows, bench, keep=every), ["coverage", "item_id"]),
        (cdc.with_spans(rows, cdc.duplicate_spans(rows)), ["spans"]),
    ]
    for got, new in results:
        assert len(got.columns) == len(set(got.columns)) and set(every) <= set(got.columns)
        found = got.collect()
        assert len(found) == len(TEXTS) and all(r[c] != "old" for r in found for c in new)
    for kept in (cdc.remove_spans(rows), simhash.keep_first(rows), simhash.keep_first(rows, jaccard=0.8), tiling.clean(rows, bench)):
        assert kept.columns == every and {r.root for r in kept.collect()} == {"old"}
    assert ppm.score(rows).count() == len(TEXTS)


def test_columns_of_the_operators_own_names_stay(spark, docs):
    names = [f"selenite_{c}" for c in "text page ids id key own of spans mark least other 0 1".split()]
    rows = docs.withColumns({c: F.lit("old") for c in [*names, "SELENITE_TEXT_"]})
    bench = spark.createDataFrame([(9, "of the passage word4 of the passage")], "item_id long, text string")
    handle = bpe.prepare(docs, corpus_pipeline.VOCABULARY, lexicon_words=5)
    every = rows.columns
    coded = bpe.encode(rows, handle, keep=every, decoded=True)
    results = [
        coded, bpe.decode(coded, handle, keep=every), simhash.fingerprints(rows, keep=every),
        simhash.near_duplicates(simhash.fingerprints(rows, keep=every), "doc_id"), sharding.shuffle(rows, 4), html_blocks.extract(rows, "text", keep=every),
        crf.score(rows, {"constant": 0.5}, keep=every), tiling.coverage(rows, bench, keep=every),
        cdc.with_spans(rows, cdc.duplicate_spans(rows)), cdc.remove_spans(rows),
    ]
    for got in results:
        found = got.collect()
        assert set(every) - {"text"} <= set(got.columns) and len(found) == len(TEXTS) and all(r[c] == "old" for r in found for c in names)
    for kept in (simhash.keep_first(rows), simhash.keep_first(rows, jaccard=0.8), tiling.clean(rows, bench)):
        assert kept.columns == every and all(r[c] == "old" for r in kept.collect() for c in names)
    assert ppm.score(rows).count() == len(TEXTS)


def test_empty_tables_give_empty_tables(spark, empty):
    assert html_blocks.extract(empty, "text", keep=["doc_id"]).count() == 0
    assert simhash.near_duplicates(simhash.fingerprints(empty, keep=["doc_id"]), "doc_id").count() == 0
    assert cdc.remove_spans(empty).count() == 0 and cdc.duplicate_spans(empty).count() == 0
    assert empty.select(licenses.scan(F.col("text")).alias("f")).count() == 0
    assert crf.score(empty, {"constant": 0.5}, keep=["doc_id"]).count() == 0
    assert minhash.links(empty, spark.createDataFrame([], "text_key long, root long"), 0.8).count() == 0


def small_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_over_nulls_and_empty_tables(spark, docs, empty, tmp_path):
    small_tables(spark, tmp_path / "a", docs)
    got = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert 0 < got.count() <= len(TEXTS) and got.columns == ["doc_id", "lang", "source", "ids", "n_tokens"]
    small_tables(spark, tmp_path / "b", empty)
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_very_long_texts(spark):
    phrase = "of the passage word4 of the passage "
    texts = ["w " * 400_000, phrase * 20_000, "x" * 700_000, "<p>" + "<b>y</b> " * 60_000, "<" * 50_000, "a\n" * 100_000, "\n".join(f"line {i} of many" for i in range(60_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(9, phrase)], "item_id long, text string")
    assert {r.doc_id: r.coverage for r in tiling.coverage(docs, bench, keep=["doc_id"]).collect()} == {i: float(i == 1) for i in range(len(texts))}
    assert html_blocks.extract(docs, "text").count() == len(texts)
    model = crf.fit(docs, spark.createDataFrame([(0, 0), (6, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in crf.score(docs, model).collect())
    assert cdc.remove_spans(docs).count() == len(texts) and simhash.fingerprints(docs).count() == len(texts)
    assert all(r.score < 0 for r in ppm.score(docs).collect())


def base_columns(text):
    words = re.findall(licenses.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = []
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases_equal_brute_force(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(docs.select("text"))
    odd = ["CC BY cc by all rights reserved General Public License", "éall rights reserved", "all rights reservedé", "cc\x00by", "CC-BY!", "cc by" * 400, "İ cc by"]
    table = table.unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    rows = table.select("text", licenses.scan(F.col("text")).alias("f")).select("text", "f.*").collect()
    for r in rows:
        assert tuple(r[c] for c in columns) == base_columns(r.text), r.text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base > 1 for r in rows)
