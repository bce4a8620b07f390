"""The training-data operators against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.llm import common, exact_dedup, jpeg, license_scan, line_dedup, media, near_dedup, packing, pieces, registry, sharding, toxicity, warc
from plyforge.llm.components import connected_components
from plyforge.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in extra.split():
        frame = frame.withColumn(name, F.lit(1))
    return frame


ODD = [None, "", "", "a", "a", "x\ny", " \t\n", "long " * 5000, "漢字 ünï ▁ <|endoftext|>", "a"]
CLASHES = "digest keep_id n covered n_lines shard slot piece component set_key license _words predicted kept"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in got.select(*columns).collect())


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def text(toxic):
        own = [rng.choice(words) for _ in range(120)]
        for k in rng.sample(range(120), 4) if toxic else []:
            own[k] = rng.choice(["blockhead", "nitwit", "dimwit", "cretin"])
        return " ".join(own)

    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    model = toxicity.fit(rows[:400])
    score = model.scorer()
    hits = [(score(t) >= model.threshold) == bool(y) for t, y in rows[400:]]
    assert sum(hits) >= 190
    assert 0 <= score(None) == score("") < model.threshold


def test_toxicity_stems_of_rare_languages():
    rng = random.Random(5)
    syllables = ["".join(p) for p in itertools.product("bdfglmnrst", "aeiou")]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    stems = {"a": "schwachk", "b": "imbécil", "c": "estúpid"}

    def text(language, toxic):
        own = [word(rng.randint(1, 3)) for _ in range(120)]
        for k in rng.sample(range(120), 5 if toxic else rng.random() < 0.1):
            own[k] = stems[language] + word(rng.randint(1, 2))
        return " ".join(own)

    rows = [("abc"[i % 3], int(i % 10 == 0)) for i in range(1500)]
    rows = [(language, text(language, label), label) for language, label in rows]
    score = (model := toxicity.fit([(t, y) for _, t, y in rows[:1000]])).scorer()
    found = Counter((language, y, score(t) >= model.threshold) for language, t, y in rows[1000:])
    for language in stems:
        assert found[language, 1, True] >= 0.8 * (found[language, 1, True] + found[language, 1, False])
        assert found[language, 0, False] >= 0.97 * (found[language, 0, True] + found[language, 0, False])


def test_toxicity_copies_count_once():
    copies = [("one family of copies with zzyzxword in it " * 3, 1)] * 40
    rows = [(f"text {i} " + ("nitwit dolt nitwit" if i % 4 == 0 else "plain words here"), int(i % 4 == 0)) for i in range(200)]
    one, many = toxicity.fit(rows + copies[:1]), toxicity.fit(rows + copies)
    assert one == many and b"zzyzx" not in many.toxic


def test_toxicity_levels_are_fitted(monkeypatch):
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(["plain", "words", "stand", "here"], k=40)), int(i % 4 == 0)) for i in range(240)]
    rows = [(f"{i} {t} " + "blockhead " * y, y) for i, (t, y) in enumerate(rows)]
    losses = {}
    for levels in toxicity.LEVELS:
        measured, loss = [], toxicity._log_loss
        with monkeypatch.context() as only:
            only.setattr(toxicity, "LEVELS", (levels,))
            only.setattr(toxicity, "_log_loss", lambda *a, m=measured, f=loss: m.append(f(*a)) or m[-1])
            assert toxicity.fit(rows).levels == levels
        losses[levels] = min(measured)
    assert losses[toxicity.fit(rows).levels] <= min(losses.values()) + 1e-3


def test_toxicity_edges(spark):
    for rows in ([], [("a", 1)], [(None, 0), (None, 1)] * 4):
        assert 0 <= toxicity.fit(rows).scorer()("text") <= 1
    model = toxicity.fit([])
    assert toxicity.score_documents(docs(spark, ODD, CLASHES), model).count() == len(ODD)
    kept = toxicity.reject_toxic(docs(spark, ODD, CLASHES), model)
    assert kept.columns == docs(spark, ODD, CLASHES).columns and kept.count() == len(ODD)
    assert toxicity.score_documents(docs(spark, []), model).count() == 0
    assert b"".join(toxicity.windows_of("aé bb " * 30 + "x" * 200)) == ("aé bb " * 30 + "x" * 200).encode()


# ---------------------------------------------------------------- near duplicates


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_shingles_match_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\té漢") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ODD
    for a, b in zip(brute_sets(texts), shingle_sets(texts), strict=True):
        assert len(a) == len(b)
    pair = brute_sets(texts), shingle_sets(texts)
    for i, j in itertools.combinations(range(60), 2):
        assert len(pair[0][i] & pair[0][j]) == len(np.intersect1d(pair[1][i], pair[1][j]))


def test_crowded_regions_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "WINDOW", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 1500)
    rng = np.random.default_rng(3)
    pool = [np.unique(rng.integers(1, 1 << 63, 200, dtype=np.uint64)) for _ in range(4)]
    rows, sets = [], []
    for i in range(60):
        own = np.unique(np.concatenate([pool[i % 4], rng.integers(1, 1 << 63, rng.integers(0, 60), dtype=np.uint64)]))
        head = b"crowd!" if i < 50 else bytes([i]) * 6
        rows.append((0, head + rng.bytes(138), i, len(own), near_dedup.sketch(own), 1 if i < 20 else i, own.tobytes()))
        sets.append(set(own.tolist()))
    frame = spark.createDataFrame(rows, "tree long, rotated binary, doc_id long, n_shingles long, sketch binary, component long, hashes binary")
    crowded = frame.withColumn("head", F.substring("rotated", 1, 6)).join(near_dedup._crowded_regions(frame), ["tree", "head"])
    assert crowded.count() == 50 and crowded.first().m_others > 2
    got = [tuple(r) for r in near_dedup._across_blocks(crowded, 75).collect()]

    def classes(links):
        label = [r[5] for r in rows[:50]]
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return len(set(label)), {tuple(i for i in range(50) if label[i] == x) for x in label}

    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert all(a < b and linked(a, b) for a, b in got)
    assert classes(got) == classes([(a, b) for a in range(50) for b in range(a + 1, 50) if linked(a, b)])
    assert near_dedup._crowded_regions(frame.where("component = 1")).count() == 0


def test_near_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += ODD
    sets = brute_sets(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dedup.near_groups(docs(spark, texts, CLASHES)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    kept = near_dedup.without_near_copies(docs(spark, texts, CLASHES))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert near_dedup.near_groups(docs(spark, [])).count() == 0


def test_no_link_is_lost_over_many_partitions(spark):
    """All of sf0.01 in 64 range partitions and with regions that partitions cut, against every pair that shares a shingle."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = documents.collect()
    sets = dict(zip([r.doc_id for r in rows], brute_sets([r.text for r in rows]), strict=True))
    holders = {}
    for i, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    common = {}
    for own in holders.values():
        for pair in itertools.combinations(sorted(own), 2):
            common[pair] = common.get(pair, 0) + 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 100
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for window in (near_dedup.WINDOW, 2):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near_dedup, "WINDOW", window)
            try:
                for k, v in conf.items():
                    spark.conf.set(k, v)
                got = {r.doc_id: r.component_id for r in near_dedup.near_groups(documents).collect()}
            finally:
                for k, v in before.items():
                    spark.conf.set(k, v)
        assert [(a, b) for a, b in links if got[a] != got[b]] == []
        edges = spark.createDataFrame(links, "a long, b long")
        want = {i: i for i in sets} | {r.node: r.component for r in connected_components(edges).collect()}
        assert got == want


def test_near_groups_broadcast_by_counted_rows(spark, monkeypatch):
    """Over the bound on counted rows no join broadcasts, however small Spark estimates the files to be; the groups are the same."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(60)]
    texts += [f"{t} {end}" for t in texts[:40] for end in "xyz"] + texts[:5]
    monkeypatch.setattr(near_dedup, "WINDOW", 2)  # all three passes
    store = spark._jsparkSession.sharedState().statusStore()

    def run():
        before = store.executionsCount()
        kept = {r.doc_id for r in near_dedup.near_groups(docs(spark, texts)).collect() if r.kept}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        made = store.executionsList()
        plans = [made.apply(i).physicalPlanDescription() for i in range(before, made.size())]
        assert len(plans) > 10
        return kept, [p for p in plans if "BroadcastHashJoin" in p.split("Initial Plan")[0]]

    few, sent = run()
    assert sent and few == set(range(60))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert run() == (few, [])


def test_near_copies_leave_by_a_merge_join_if_many(spark, monkeypatch):
    """Over the bound on counted rows the dropped identifiers are not broadcast, however small their file; the documents are the same."""
    texts = ["one two three four five six"] * 3 + ["seven eight nine ten eleven twelve"]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    stays = near_dedup.without_near_copies(docs(spark, texts))
    assert sorted(r.doc_id for r in stays.collect()) == [0, 3]
    plan = stays._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_near_groups_without_identifier(spark):
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (5, "one two three four five six"), (None, None)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(3, 2, 3, True), (5, 2, 3, False)]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (2, None, True)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(5, 5), (8, 7), (8, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 40)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- pieces


def all_segmentations(model, word):
    into = model._edges(word)

    def rec(end):
        if end == 0:
            yield 0.0, (), ()
            return
        for start, i, score in into[end]:
            for total, ids, path in rec(start):
                yield total + score, (*ids, *model._emitted(word[start:end], i)), (*path, i)

    return sorted(rec(len(word)), key=lambda x: (-x[0], x[2][::-1]))


def test_n_best_matches_enumeration():
    model, rng = pieces.load(pieces.MODEL), random.Random(2)
    for _ in range(120):
        word = "".join(rng.choice("abthe▁qéß漢\n") for _ in range(rng.randint(1, 8)))
        want = [(s, ids) for s, ids, _ in all_segmentations(model, word)[:4]]
        assert model.n_best(word, 4) == want
        model.learn({word})
        assert model._known[word][1] == want[0][0] and tuple(np.frombuffer(model._known[word][0], "<u4")) == want[0][1]
    for _ in range(60):
        text = "".join(rng.choice("abthe  \n") for _ in range(rng.randint(0, 8)))
        words = model.words(text)
        model.learn(set(words))
        each = [all_segmentations(model, w) for w in words]
        ways = itertools.product(*[range(len(e)) for e in each])
        ranked = sorted((-sum(e[r][0] for e, r in zip(each, way, strict=True)), way[::-1]) for way in ways)[:4]
        want = [(-s, sum((e[r][1] for e, r in zip(each, way[::-1], strict=True)), ())) for s, way in ranked]
        assert [(s, tuple(np.frombuffer(ids, "<u4"))) for s, ids in model.encode(words, 4)] == want


def test_pieces_edges(spark):
    got = {r.doc_id: r for r in pieces.digests(docs(spark, ODD, CLASHES)).collect()}
    assert len(got) == len(ODD) and all(r.round_trip for r in got.values())
    assert got[0].n_pieces == 0 and got[0].scores == [0.0]
    rows = pieces.encode_texts(docs(spark, ODD)).where("rank = 0").collect()
    assert {r.doc_id: r.text for r in rows} == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD)}
    assert pieces.digests(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- lines


def brute_lines(texts):
    seen, covered = set(), defaultdict(set)
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                covered[i].update((p, p + 1, p + 2))
            seen.add(w)
    return [t if t is None or i not in covered else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in covered[i]) for i, t in enumerate(texts)]


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ODD
    frame = docs(spark, texts, CLASHES)
    got = line_dedup.remove_repeated_lines(frame)
    assert [r.text for r in got.orderBy("doc_id").collect()] == brute_lines(texts)
    assert line_dedup.remove_repeated_lines(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- sharding


def test_lines_of_rows_that_share_an_identifier(spark):
    rows = [(4, "a\nb\nc"), (4, "x\na\nb\nc"), (None, "a\nb\nc\nd"), (5, "p\nq\nr"), (5, "p\nq\nr"), (6, None)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in got) == [(0, 4, 0), (4, 3, 3), (4, 4, 3), (5, 3, 0), (5, 3, 0), (6, 0, 0)]


def test_sharding_matches_brute_force(spark):
    frame = docs(spark, [f"t{i % 7}" for i in range(900)] + ODD, CLASHES)
    rows = sharding.shuffle_into_shards(frame, shards=5).collect()
    assert len(rows) == 900 + len(ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        uniforms = [int(hashlib.md5(f"{sharding.SEED}:{j // 4}:{r.doc_id}".encode()).hexdigest()[8 * (j % 4) : 8 * (j % 4) + 8], 16) for j in range(6)]
        at = [max(j for j in range(n) if j == 0 or uniforms[j] * (j + 1) < 1 << 32) for n in (5, 6)]
        assert (r.shard, r.grown_shard) == tuple(at) and (r.grown_shard in (r.shard, 5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r.doc_id: r.text or "" for r in frame.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    again = sharding.shuffle_into_shards(frame.repartition(7), shards=5).collect()
    assert {(r.doc_id, r.slot) for r in rows} == {(r.doc_id, r.slot) for r in again}
    assert sharding.shuffle_into_shards(docs(spark, [])).count() == 0
    twice = sharding.shuffle_into_shards(frame.union(frame), shards=2).collect()
    assert sorted(r.slot for r in twice if r.shard == 0) == list(range(sum(r.shard == 0 for r in twice)))


def test_shards_are_written_in_slot_order(spark, tmp_path):
    frame = docs(spark, [f"t{i}" for i in range(200)])
    sharding.write_shards(frame, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.groupBy("shard").agg(F.max("slot") + 1 - F.count("slot")).agg(F.sum(F.col("((max(slot) + 1) - count(slot))"))).first()[0] == 0


# ---------------------------------------------------------------- licences


def test_license_edges(spark):
    texts = [*ODD, "x\nLicensed under CC BY-NC 4.0.\ny", "This program is free software: you can redistribute it and/or modify it under the\nterms of the GNU General Public License as published by the Free Software Foundation"]
    got = license_scan.scan_licenses(docs(spark, texts, CLASHES)).orderBy("doc_id").collect()
    assert [r.license for r in got] == [None] * len(ODD) + ["CC-BY-NC", "GPL"]
    assert got[-2].license_line == 1 and got[-1].license_line == 0
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_license_notices_that_are_wrapped_or_repeated(spark):
    mit = next(w for name, w in license_scan.TEMPLATES if name == "MIT" and "NONINFRINGEMENT" in w)
    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software Foundation"
    words = mit.split()
    wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    prose = "nothing here speaks about that matter at all\n"
    texts = [prose * 3 + wrapped + "\n\n" + prose * 400, wrapped, mit, *["\n".join([gpl] * n) for n in (1, 6, 8, 60)], prose * 9]
    got = license_scan.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT"] * 3 + ["GPL"] * 4 + [None]
    assert [r.license_line for r in got][:3] == [3, 0, 0] and got[0].license_dice > 0.9 and got[2].license_dice == 1


# ---------------------------------------------------------------- packing


def test_packing_is_a_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["word " * n for n in (1022, 1023, 1024, 2500)] + [f"some text {i} " * (i % 40) for i in range(200)]
    rows = packing.pack_documents(docs(spark, texts, CLASHES)).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in enumerate(texts):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.length for r in own] == packing.piece_lengths(len(ids))
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_best_configuration_matches_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        worth = np.concatenate([[0.0], rng.random(9)])
        chosen = packing.best_configuration(worth)
        best = max(
            sum(worth[n] * k for n, k in enumerate(counts, 1))
            for counts in itertools.product(*[range(9 // n + 1) for n in range(1, 10)])
            if sum(n * k for n, k in enumerate(counts, 1)) <= 9
        )
        assert sum(n * k for n, k in chosen.items()) <= 9
        assert sum(worth[n] * k for n, k in chosen.items()) == pytest.approx(best)


def test_plan_places_every_piece_once():
    histogram = np.random.default_rng(2).integers(0, 30, 1025)
    histogram[0] = 0
    groups = packing.plan_sequences(histogram, rounds=100)
    placed = Counter()
    for lengths, times in groups:
        assert sum(lengths) <= 1024
        for n in lengths:
            placed[n] += times
    assert all(placed[n] == histogram[n] for n in range(1, 1025))


# ---------------------------------------------------------------- WARC


def test_chunked_framing_round_trips():
    for n in (0, 1, 4096, 4097, 10_000):
        body = os.urandom(n)
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.dechunked(bad)


def pages(spark, htmls):
    return spark.createDataFrame([(i, None if i % 3 else f"http://x/{i}\r\n", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    htmls = [None, "", "é" * 30_000, "é" * 30_000, "WARC/1.1\r\n\r\nx\r\n\r\n", "a\r\n\r\n", *[f"p{i % 5}" * 200 for i in range(40)]]
    warc.write_archives(pages(spark, htmls), str(tmp_path / "w"), segment_bytes=1000)
    rows = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == len(htmls) and all(r.problem is None for r in rows.values())
    last = {h or "": i for i, h in enumerate(htmls)}
    for i, h in enumerate(htmls):
        if last[h or ""] == i:
            assert rows[i].type == "response" and bytes(rows[i].payload).decode() == (h or "")
        else:
            assert rows[i].type == "revisit" and rows[i].refers_to == warc.record_id(last[h or ""])


def test_incomplete_sets_are_named(spark, tmp_path):
    warc.write_archives(pages(spark, ["x" * 5000]), str(tmp_path / "w"), segment_bytes=1000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    problem = lambda r: warc.reassembled(r).first().problem
    assert problem(records) is None
    assert "missing" in problem(records.where("segment != 2"))
    assert "no total" in problem(records.where("total is null"))
    assert "not that" in problem(records.withColumn("total", F.col("total") + 1))


def test_pages_without_identifier_or_that_repeat(spark, tmp_path):
    rows = [(None, None, "a" * 40_000), (None, "u", "b"), (7, "u", "c" * 40_000), (7, "u", "c" * 40_000), (7, "v", "b"), (8, "w", "c" * 40_000), (9, "w", "b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len({r.record_id for r in got}) == 7 and all(r.problem is None for r in got)
    by_id = {r.record_id: r for r in got}
    kinds = sorted((r.page_id or 0, r.type, by_id[r.refers_to].page_id if r.refers_to else 0) for r in got)
    assert kinds == [(0, "response", 0), (0, "response", 0), (7, "revisit", 8), (7, "revisit", 8), (7, "revisit", 9), (8, "response", 0), (9, "response", 0)]
    assert sorted(len(r.payload) for r in got if r.type == "response") == [1, 1, 40_000, 40_000]
    warc.write_archives(frame.limit(0), str(tmp_path / "e"))


# ---------------------------------------------------------------- exact duplicates


def test_exact_groups_edges(spark):
    frame = docs(spark, ODD, CLASHES)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame, "max").collect()}
    groups = defaultdict(list)
    for i, t in enumerate(ODD):
        groups[t or ""].append(i)
    for own in groups.values():
        for i in own:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
    kept = exact_dedup.without_copies(frame.union(frame), "min")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(own) for own in groups.values())
    assert kept.columns == frame.columns
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, "any")


def test_runs_merge_over_time(spark):
    index = exact_dedup.DigestIndex(spark)
    for ids in ((5, 7), (3, 9)):
        index.flush(spark.createDataFrame([(bytearray(b"d"), i) for i in ids], "digest binary, id long"))
    batch = spark.createDataFrame([(bytearray(b"d"), 1), (bytearray(b"x"), 2)], "digest binary, doc_id long")
    for _ in range(2):
        assert [(r.doc_id, r.keep_id, r.n) for r in index.lookup(batch).collect()] == [(1, 3, 4)]
        assert [(r.keep_id, r.n) for r in index.compact().collect()] == [(3, 4)] and len(index.runs) == 1


@pytest.mark.parametrize("sent", [exact_dedup.BROADCAST_BYTES, 0])
def test_filters_leave_out_what_no_other_run_holds(spark, monkeypatch, sent):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", sent)
    index, shuffled = exact_dedup.DigestIndex(spark, "max"), []
    for start in (0, 900):
        frame = spark.range(start, start + 1000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
        index.flush(frame, 1)
    merged = index._merged
    monkeypatch.setattr(index, "_merged", lambda e: shuffled.append(e.count()) or merged(e))
    got = {bytes(r.digest): (r.keep_id, r.n) for r in index.compact().collect()}
    want = {hashlib.sha256(str(i).encode()).digest(): (i, 2 if 900 <= i < 1000 else 1) for i in range(1900)}
    assert got == want and (shuffled == [2000] if not sent else 200 <= shuffled[0] < 700)


# ---------------------------------------------------------------- media


def test_coefficients_hold_any_bytes():
    for n in (64, 128, 384, 448, 64 * 53):
        for payload in (os.urandom(n), bytes(n), b"\xff" * n):
            frame = jpeg.decode_coefficients(jpeg.encode_payload(payload))
            assert jpeg.stored_payload(frame) == payload
            assert jpeg.to_rgb(frame).shape == (frame.height, frame.width, 3)
    for bad in (b"", b"\xff\xd8\xff\xd9", jpeg.encode_payload(bytes(64))[:-40]):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode_coefficients(bad)


class Writer:
    """A code-by-code scan writer with tables of many codes, for the decoder's general path."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def bytes(self):
        return np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), dtype=np.uint8)).tobytes()


def test_general_scans():
    """A grey 24 x 16 picture with a DC scan of differences, an AC scan with runs and ends, and its refinement."""
    rng = np.random.default_rng(3)
    want = np.zeros((6, 64), dtype=np.int64)
    want[:, 0] = rng.integers(-200, 200, 6)
    for row in want[:5]:
        row[rng.choice(np.arange(1, 64), 7, replace=False)] = rng.integers(-40, 41, 7)
    table = lambda kind: jpeg._marker(0xC4, bytes([kind << 4, *[0] * 7, 255, *[0] * 8, *range(255)]))  # noqa: E731  code k of 8 bits is symbol k
    dc = Writer()
    for v, before in zip(want[:, 0], [0, *want[:-1, 0]], strict=True):
        d = int(v - before)
        dc.put(abs(d).bit_length(), 8)
        dc.signed(d)
    half = np.sign(want) * (abs(want) >> 1)
    first = Writer()
    for row in half:
        run = 0
        for k in range(1, 64):
            if row[k] == 0:
                run += 1
                continue
            while run > 15:
                first.put(0xF0, 8)
                run -= 16
            first.put(run << 4 | abs(int(row[k])).bit_length(), 8)
            first.signed(int(row[k]))
            run = 0
        if run:
            first.put(0, 8)
    second = Writer()
    for row, had in zip(want, half, strict=True):
        run, held = 0, []
        last = max([k for k in range(1, 64) if abs(row[k]) == 1], default=0)
        for k in range(1, 64):
            if had[k]:
                held.append(abs(int(row[k])) & 1)
                continue
            if abs(row[k]) != 1:
                run += 1
                if run == 16 and k < last:
                    second.put(0xF0, 8)
                    [second.put(b, 1) for b in held]
                    run, held = 0, []
                continue
            second.put(run << 4 | 1, 8)
            second.put(int(row[k] > 0), 1)
            [second.put(b, 1) for b in held]
            run, held = 0, []
        second.put(0, 8)
        [second.put(b, 1) for b in held]
    frame = b"\x08\x00\x10\x00\x18\x01\x01\x11\x00"
    file = b"\xff\xd8" + jpeg._marker(0xDB, bytes([0] + [1] * 64)) + jpeg._marker(0xC2, frame) + table(0) + table(1)
    file += jpeg._scan((1,), 0, 0, 0, 0, dc.bytes()) + jpeg._scan((1,), 1, 63, 0, 1, first.bytes()) + jpeg._scan((1,), 1, 63, 1, 0, second.bytes())
    got = jpeg.decode_coefficients(file + b"\xff\xd9")
    assert (got.components[0].coefficients.reshape(-1, 64) == want).all()
    assert jpeg.to_rgb(got).shape == (16, 24, 3)


def test_inverse_transform_matches_the_definition():
    c = np.zeros((1, 64), dtype=np.float32)
    c[0, 5] = 100
    u, v = divmod(int(jpeg.ZIGZAG[5]), 8)
    a = lambda k: np.sqrt(1 / 8) if k == 0 else 0.5
    want = [100 * a(u) * a(v) * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for x in range(8) for y in range(8)]
    assert np.allclose(c @ jpeg._IDCT, want, atol=1e-3)
    assert sorted(jpeg.ZIGZAG) == list(range(64)) and list(jpeg.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2]


def test_media_edges(spark):
    frame = docs(spark, ODD, CLASHES)
    rows = media.decode_media(media.encode_texts(frame)).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        n, body = media.padded(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert len(r.rgb) == 3 * r.height * r.width
    assert rows[1].media_sha256 == rows[2].media_sha256 and rows[1].feature == rows[2].feature
    assert media.decode_media(media.encode_texts(docs(spark, []))).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == frame.columns
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert before.count() >= kept.count() > 0.8 * frame.count()
