"""The numbered operators on small hand-made rows, and against brute force on the smallest tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from timbrel.llm import budget, catalogue, languages, leaks, lookalike, packing, reading, runs, splitting, tokenizers, turns
from timbrel.session import shared_path

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
needs_tokenizers = pytest.mark.skipif(not os.path.isdir(tokenizers.FOLDER), reason="no vocabularies here")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1 splitting


def check_pieces(text, pieces, limit, overlap):
    for i, p in enumerate(pieces):
        assert p["piece_index"] == i and p["piece_text"] == text[p["char_start"] : p["char_end"]]
        n = len(splitting.tokens(np.frombuffer(p["piece_text"].encode("utf-32-le"), np.uint32))[0])
        assert n == p["token_count"] <= limit and p["overlap_tokens"] == (overlap if i else 0)
    assert pieces[0]["char_start"] == 0 and pieces[-1]["char_end"] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        shared = text[b["char_start"] : a["char_end"]]
        assert len(splitting.tokens(np.frombuffer(shared.encode("utf-32-le"), np.uint32))[0]) == overlap


def test_pieces_hold_limit_overlap_and_text(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma.", "delta,", "x_1", "été", "数列", "ｗ", "-", "no"]
    texts = ["", None, "   ", "one two", " ".join(rnd.choice(words) for _ in range(900)), "変" * 700, "a" * 5000, "\n".join("line %d of talk" % i for i in range(200)), "!?" * 400, "w " * 240, "w " * 241]
    df = spark.createDataFrame([(i, t, 9, 0 if i % 2 else 100, 100 if i % 2 else 0, "k") for i, t in enumerate(texts)], "id int, text string, token_count int, a int, b int, piece_text string")
    out = splitting.split_oversized(df, "text", start="a", end="b")
    assert {"token_count_input", "piece_text_input"} <= set(out.columns)
    got = {}
    for r in out.orderBy("id", "piece_index").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        if t is None:
            assert len(got[i]) == 1 and got[i][0]["piece_text"] is None and got[i][0]["token_count"] == 0
            continue
        check_pieces(t, got[i], 240, 48)
        assert got[i][0]["piece_start"] == 0 and got[i][-1]["piece_end"] == 100
        assert all(x["piece_start"] < x["piece_end"] for x in got[i] if x["token_count"])
    assert [len(got[i]) for i in (0, 2, 3, 6, 9, 10)] == [1, 1, 1, 1, 1, 2]


def _talk(rnd, sentences):
    """Sentences of common words and of a topic's own, whose topics share some words; (text, tokens before each change)."""
    common, words = "the of a to and in we is that it for on with as this".split(), [f"w{i}" for i in range(120)]
    said, changes, at = [], [], 0
    for _ in range(6):
        own = rnd.sample(words, 25)
        for _ in range(sentences):
            k = rnd.randrange(7, 13)
            said.append(" ".join(rnd.choice(common) if rnd.random() < 0.5 else rnd.choice(own) for _ in range(k)) + ".")
            at += k + 1
        changes.append(at)
    return " ".join(said), changes[:-1]


def test_cuts_fall_between_topics():
    """Planted changes of topic every 170 tokens or so, one at least in each window: how many cuts fall on one, against cuts at any sentence end."""
    rnd, hit, chance, n = random.Random(2), 0, 0, 0
    for _ in range(60):
        text, changes = _talk(rnd, 17)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start, end, pieces = splitting.cut_places(cps, 240, 0)
        kind = splitting.pauses(cps, start, end)
        for first, _, stop in pieces[:-1]:
            lo, hi = first + 120, first + 240
            near = [c for c in changes if lo <= c <= hi]
            if near:
                n += 1
                hit += any(abs(stop - c) <= 12 for c in near)
                ends = [p for p in range(lo, hi + 1) if kind[p] == 4]
                chance += sum(any(abs(p - c) <= 12 for c in near) for p in ends) / len(ends)
                assert kind[stop] == 4
    print("cuts at a change of topic", hit / n, "by chance", chance / n)
    assert n > 150 and hit / n > 0.75 and hit / n > 2.5 * chance / n


def test_a_deep_valley_outweighs_a_better_pause():
    a, b = ([f"{p}{i % 10}" for i in range(150)] for p in "ab")
    cut = lambda text: splitting.cut_places(np.frombuffer(text.encode("utf-32-le"), np.uint32), 240, 0)[2][0][2]
    # the topic changes at a clause end after 151 tokens; a line ends elsewhere in the window
    assert cut(" ".join(a) + ", " + " ".join(b[:60]) + "\n" + " ".join(b)) == 151
    # a sentence end without a valley is better than a word inside one topic
    assert cut(" ".join(a) + " " + " ".join(a[:40]) + ". " + " ".join(a)) == 191


def test_cosines_and_depths_in_strips(monkeypatch):
    rnd = np.random.default_rng(1)
    word = rnd.integers(0, 30, 700)
    square = rnd.uniform(0.5, 2, 30)[word]
    got = splitting._cosines(word, square, 20)
    for p in (0, 1, 7, 20, 21, 350, 690, 699):
        left, right = word[max(0, p - 20) : p], word[p : p + 20]
        weight = dict(zip(word.tolist(), square.tolist()))
        dot = lambda x, y: sum(weight[int(u)] for u in x for v in y if u == v)
        assert got[p] == pytest.approx(dot(left, right) / max(1e-6, dot(left, left) * dot(right, right)) ** 0.5)
    cps = np.frombuffer(_talk(random.Random(3), 40)[0].encode("utf-32-le"), np.uint32)
    start, end = splitting.tokens(cps)
    whole = splitting.depths(cps, start, end)
    monkeypatch.setattr(splitting, "STRIP", 500)
    assert np.allclose(whole, splitting.depths(cps, start, end), atol=1e-5)


def test_limit_must_exceed_overlaps(spark):
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame([], "t string"), "t", 10, 5)
    assert splitting.split_oversized(spark.createDataFrame([], "t string"), "t").count() == 0


# --- 2 tokens


EN, ES = "the cat and the dog sleep in the house while we walk to the river ", "el perro y los gatos duermen en la casa según nuestra vecina mientras caminamos al río "


def profiles(spark):
    data = [(EN * 60, "en"), (EN * 50, "EN-us"), (ES * 60, " es"), (EN * 40, "xx"), (ES * 40, "English"), (None, "en"), ("", "fr"), (EN, "en"), (ES, None)]
    return languages.fitted(spark.createDataFrame(data, "text string, label string"))


def test_languages_are_those_of_the_labels(spark):
    model = profiles(spark)
    assert model.names == ["en", "es"]  # xx has the profile of en, fr no letters
    got, sure = model.of(pa.array(["We walk to the house", "caminamos con los gatos en la casa", None, "", "18 + 3", "네 그리고 이것은 한국어", "dog"]))
    assert got == ["en", "es", None, "und", "und", "und", "en"] and sure[:2] == [True, True] and not any(sure[2:6])
    assert languages.fitted(spark.createDataFrame([], "text string, label string")).of(pa.array(["a", None]))[0] == ["und", None]


@needs_tokenizers
@pytest.mark.parametrize("feed", [False, True])
def test_ledger_follows_changes_and_removals(spark, feed):
    kind = "tbl string, id bigint, source string, domain string, text string, whole_text string"
    main = "the cat and the dog sleep in the house"

    def units(data):
        rows_ = [(*r, main if r[4] in (main, "18 + 3") else r[4]) for r in data]
        df = spark.createDataFrame(rows_, kind).withColumn("content", F.unhex(F.md5("text"))).withColumn("whole", F.unhex(F.md5("whole_text")))
        texts = df.select("content", "text").unionByName(df.select(F.col("whole").alias("content"), F.col("whole_text").alias("text")))
        return df.select("tbl", "id", "source", "domain", "content", "whole"), texts

    ledger = budget.TokenLedger(spark, shared_path(spark, "t"), profiles(spark))
    cat, gatos = "el perro y los gatos duermen", "el perro y los gatos duermen en la casa según"
    first = [("d", 1, "s", "x", main), ("d", 2, "s", "x", main), ("d", 3, "t", "y", cat), ("d", 4, "t", "y", ""), ("d", 6, None, "x", main)]
    ledger.load(*units(first))
    second = [("d", 1, "s", "x", main), ("d", 3, "t", "y", gatos), ("d", 5, "u", "x", main), ("d", 6, None, "x", main)]
    if feed:
        changed, texts = units(second[1:3])
        delta = ledger.change(changed, spark.createDataFrame([("d", 2), ("d", 4), ("d", 99)], "tbl string, id bigint"), texts)
    else:
        delta = ledger.load(*units(second))
    count = tokenizers.encoder(f"{tokenizers.FOLDER}/{tokenizers.DEFAULT}")
    n, old, new = count(main), count(cat), count(gatos)
    assert {(r["source"], r["language"]): (r["units"], r["tokens"]) for r in delta.collect()} == {("s", "en"): (-1, -n), ("t", "es"): (0, new - old), ("t", "und"): (-1, 0), ("u", "en"): (1, n)}
    assert {(r["source"], r["units"], r["tokens"]) for r in ledger.cube().collect()} == {("s", 1, n), ("t", 1, new), ("u", 1, n), (None, 1, n)}
    alone = budget.TokenLedger(spark, shared_path(spark, "t"), profiles(spark))
    alone.load(*units(second))
    assert alone.cube().exceptAll(ledger.cube().select(alone.cube().columns)).isEmpty() and alone.cube().count() == ledger.cube().count()
    # contents that were met before aren't encoded again, and nothing moves without a change
    assert spark.read.parquet(f"{ledger.store.root}/{ledger.manifest()['counts'][-1]}").count() == 1
    before = ledger.manifest()["units"]
    assert ledger.load(*units(second)).count() == 0 and ledger.manifest()["units"] == before
    # words that tell no language take that of the text they were cut from
    ledger.load(*units([*second, ("d", 9, "v", "x", "18 + 3")]))
    assert ledger.cube().where("source = 'v'").first()["language"] == "en"
    assert sum(a != b for a, b in ((before.get(k), v) for k, v in ledger.manifest()["units"].items())) == 1
    ledger.load(*units([]))
    assert ledger.cube().count() == 0 and ledger.manifest()["units"] == {}


def test_what_the_chunk_before_has_told_is_left_out(spark):
    rnd = random.Random(22)
    words = [f"w{i}" for i in range(3000)]
    chunks, at = [], 0
    for i in range(0, 400):
        chunks.append((i, 1 if i < 300 else 2, i * 3, " ".join(words[at : at + 12])))
        at += rnd.choice([4, 7, 12, 15])
    chunks += [(900, 3, 0, None), (901, 3, 5, "no neighbour at all"), (902, None, 1, "without an owner")]
    df = spark.createDataFrame(chunks, "chunk_id int, transcript_id int, chunk_index int, text string")
    got = {r["chunk_id"]: r["text"] for r in budget.own_texts(df.repartition(3)).collect()}
    last = {}
    for i, o, _, t in chunks:
        if t is not None:
            assert got.pop(i) == (t[budget.shared(last[o], t) :] if o in last else t)
            last[o] = t
    assert not got and budget.own_texts(df.limit(0)).count() == 0


@needs_data
@needs_tokenizers
def test_budget_against_a_plain_recount(spark):
    """Units and tokens by table, source and domain, counted one row at a time from the tables."""
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("transcripts", "chunks", "videos", "sources", "documents")}
    count = tokenizers.encoder(f"{tokenizers.FOLDER}/{tokenizers.DEFAULT}")
    names = {r["source_id"]: r["source_name"] for r in t["sources"]}
    told = {}
    for r in t["documents"]:
        if r["topic_domain"] not in (None, "unresolved") and r["video_id"] is not None:
            told.setdefault(r["video_id"].strip(), set()).add(r["topic_domain"])
    domains = {d for r in t["documents"] if (d := r["topic_domain"]) not in (None, "unresolved")}
    where = {}
    for r in t["videos"]:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in f"{r['title'] or ''} {r['description'] or ''}".lower()).split())
        named, agreed = words & domains, told.get(r["video_id"].strip(), set())
        where[r["video_id"].strip()] = (names.get(r["source_id"], "unknown"), min(named) if len(named) == 1 else min(agreed) if len(agreed) == 1 else "unresolved")
    first, want = {}, {}
    for r in sorted(t["transcripts"], key=lambda r: r["transcript_id"]):
        look = r["transcript_id"] if r["raw_text"] is None else brute.look(r["raw_text"])
        first.setdefault((r["video_id"].strip(), look), r)
    owner = {r["transcript_id"]: where.get(r["video_id"].strip(), ("unknown", "unresolved")) for r in first.values()}

    def add(tbl, dims, text):
        n, k = want.get((tbl, *dims), (0, 0))
        want[tbl, *dims] = (n + 1, k + count(text))

    for r in first.values():
        if r["raw_text"] is not None:
            add("transcripts", owner[r["transcript_id"]], r["raw_text"])
    before = {}
    for r in sorted((r for r in t["chunks"] if r["chunk_text"] is not None), key=lambda r: (r["transcript_id"], r["chunk_index"])):
        o, text = r["transcript_id"], r["chunk_text"]
        if o in owner:
            p = before.get(o, "")
            k = next((k for k in range(min(len(p), len(text)), budget.LEAST_OVERLAP - 1, -1) if p.endswith(text[:k])), 0)
            add("chunks", owner[o], text[k:])
        before[o] = text
    got = budget.p2_token_budget(spark, SF).groupBy("tbl", "source", "domain").agg(F.sum("units"), F.sum("tokens")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


def test_shared_ends():
    assert budget.shared("we say a thing twice here", "a thing twice here and go on") == len("a thing twice here")
    assert budget.shared("abc", "abc") == 0 and budget.shared("x" * 30, "x" * 20) == 20 and budget.shared("no overlap at all", "something else here") == 0


@needs_tokenizers
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "<|endoftext|>", 5)], "id int, text string, tokens int")
    got = {r["id"]: r["tokens"] for r in tokenizers.with_token_count(df, "text", name).collect()}
    assert got[1] == tokenizers.encoder(f"{tokenizers.FOLDER}/{name}")("hello world") in (2, 3) and got[2] is None and got[3] == 0 and got[4] > 1
    assert tokenizers.fingerprint(name) != tokenizers.fingerprint("word_bpe_49k.json")


# --- 4 looks


def test_pairs_of_looks(spark):
    data = [("t", 1, "v", "Café"), ("t", 2, "v", "Café"), ("t", 3, "v", "Саfé"), ("t", 4, "v", "Café"), ("t", 5, "v", "Cafe"), ("t", 6, "w", "Саfé"), ("u", 7, "v", "Саfé"), ("t", 8, "v", ""), ("t", 9, "v", "​")]
    df = spark.createDataFrame(data, "tbl string, id bigint, video string, text string")
    got = rows(lookalike.look_alike_pairs(lookalike.digests(df)))
    assert got == [("t", 1, 2), ("t", 1, 3), ("t", 2, 3), ("t", 2, 4), ("t", 3, 4), ("t", 8, 9)]
    assert lookalike.look_alike_pairs(lookalike.digests(df.limit(0))).count() == 0
    extra = spark.createDataFrame([(1, None, "x"), (2, "ﬁ", None)], "n int, text string, look string")
    assert rows(lookalike.consistent_text(extra, "text").fillna("-")) == [(1, "-", "x"), (2, "fi", "-")]


@needs_data
def test_consistent_text_of_both_tables(spark):
    got = lookalike.p4_consistent(spark, SF)
    ids = {"transcripts": "transcript_id", "transcripts_raw": "raw_id"}
    for name, c in ids.items():
        want = spark.read.parquet(f"{SF}/{name}.parquet").select(F.col(c).cast("bigint"))
        assert rows(got.where(F.col("tbl") == name).select("id")) == rows(want)
    looks = {(r["tbl"], r["id"]): r["consistent_text"] for r in got.collect()}
    pairs = lookalike.p4_found(spark, SF).collect()
    assert pairs and all(looks[r["tbl"], r["id_a"]] == looks[r["tbl"], r["id_b"]] is not None for r in pairs)


# --- 6 runs


def events(spark, data):
    return spark.createDataFrame(data, "entity string, idx int, start double, dur double, text string")


def test_runs_pass_over_signs_and_order_by_start(spark):
    data = [("a", 0, 5.0, 1.0, "Hello, World"), ("a", 1, 4.0, 1.0, "hello world!"), ("a", 2, 6.0, None, "♪"), ("a", 3, 7.0, -1.0, "HELLO-WORLD"), ("a", 4, 8.0, 1.0, "hello worlds"), ("a", 5, None, 1.0, "hello worlds"), ("b", 0, 1.0, 1.0, None), (None, 0, 1.0, 1.0, "x"), (None, 1, 1.0, 1.0, "x")]
    got = runs.collapse_runs(events(spark, data), least=2).select("entity", "first_index", "last_index", "n", "total_ms").collect()
    assert {tuple(r) for r in got} == {("a", 1, 3, 3, 2000), ("a", 4, 5, 2, 2000), (None, 0, 1, 2, 2000)}
    assert runs.collapse_runs(events(spark, [])).count() == 0


def test_runs_across_tasks(spark):
    rnd = random.Random(6)
    data, i = [], 0
    while i < 5000:
        k = rnd.choice([1, 1, 2, 3, 900])
        data += [("hot", i + j, float(i + j), 0.5, f"text {i}") for j in range(k)]
        i += k
    rnd.shuffle(data)
    data.append(("cold", 0, 1.0, 1.0, "x"))
    got = runs.collapse_runs(events(spark, data).repartition(5))
    by_text = {}
    for _, idx, *_, t in data[:-1]:
        by_text.setdefault(t, []).append(idx)
    want = sorted((min(v), max(v), len(v)) for v in by_text.values())
    assert rows(got.where("entity = 'hot'").select("first_index", "last_index", "n")) == want


def test_similar_runs_and_gaps(spark):
    data = [("a", 0, 0.0, 1.0, "the quick brown fox"), ("a", 1, 1.0, 1.0, "the quick brown fix"), ("a", 2, 2.0, 1.0, "the quack brown fix"), ("a", 3, 60.0, 1.0, "the quick brown fox"), ("a", 4, 61.0, 1.0, "another thing")]
    near = runs.collapse_runs(events(spark, data), similarity=0.65, max_gap_ms=5000)
    assert rows(near.select("first_index", "last_index", "n")) == [(0, 2, 3), (3, 3, 1), (4, 4, 1)]
    assert runs.collapse_runs(events(spark, [("a", 0, 0.0, 1.0, "x"), ("a", 1, 9.0, 1.0, "x")]), 2, max_gap_ms=5000).count() == 0


@pytest.mark.parametrize("similarity, gap", [(0.8, None), (0.8, 1500)])
def test_hot_entity_is_walked_by_many_tasks(spark, similarity, gap):
    """Against a plain walk of each entity: drifting texts, so that runs depend on their anchors and cross tasks."""
    rnd = random.Random(66)
    data, text, t = [], "abcdefghijklmnopqrst", 0
    for i in range(1200):
        if rnd.random() < 0.4:
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice("abcxyz") + text[k + 1 :]
        if rnd.random() < 0.02:
            text = "".join(rnd.choice("abcdefghij") for _ in range(20))
        t += rnd.choice([0, 500, 500, 1000, 3000])
        data.append(("hot" if i < 1000 else f"e{i % 3}", i, t / 1000, rnd.choice([0.5, 1.0, 2.0, None]), text))
    want = []
    for entity in sorted({d[0] for d in data}):
        run = None
        for _, i, s, d, x in (e for e in data if e[0] == entity):
            start, end = round(s * 1000), round(s * 1000 + (d or 0) * 1000)
            if run and runs.likeness(run[4], x) >= similarity and (gap is None or start - run[3] <= gap):
                run[1], run[2], run[3] = i, run[2] + 1, max(run[3], end)
                continue
            if run:
                want.append((entity, *run[:3]))
            run = [i, i, 1, end, x]
        want.append((entity, *run[:3]))
    got = runs.collapse_runs(events(spark, data).repartition(3), similarity=similarity, max_gap_ms=gap)
    assert rows(got.select("entity", "first_index", "last_index", "n")) == sorted(want)


def test_small_letters_follow_their_own_shape(spark):
    data = [("a", i, float(i), 1.0, t) for i, t in enumerate(["М", "M", "m", "м", "м", "α", "a", "STRASSE", "straße"])]
    got = runs.collapse_runs(events(spark, data), least=2)
    assert rows(got.select("first_index", "last_index")) == [(0, 2), (3, 4), (7, 8)]


# --- 7 turns

def payloads(spark, segs):
    """Rows (raw_id, idx, start, text), indexes ascending, to payloads; a payload without segments, and one whose segments are null."""
    rows_ = {}
    for rid, _, start, text in segs:
        rows_.setdefault(rid, []).append((text, start))
    return spark.createDataFrame([*rows_.items(), (-1, []), (-2, None)], "raw_id bigint, segments array<struct<text:string,start:double>>")


SPEAKERS = [(1, "Ilse Marrow", "instructor"), (2, "Tobin Keshwick", "guest"), (3, "Student", "unnamed"), (4, "Audience", "unnamed")]


@pytest.mark.parametrize(
    "label, who",
    [("Ilse Marrow", 1), ("MARROW, Ilse", 1), ("I. Marrow", 1), ("Prof. Mrrow", 1), ("PRFESSOR MARROW", 1), ("ilse", 1), ("I.", None), ("Tobin Marrow", None), ("Keshwikc", 2), ("Dr Tobin", 2), ("student", 3), ("Student 2", 3), ("Audience member", 4), ("[AUDIENCE LAUGHS]", None), ("Theorem", None), ("(Student)", 3), ("Marrow member", None), ("", None), ("Professor", None)],
)
def test_labels(spark, label, who):
    got = turns.named(spark.createDataFrame([(label,)], "label string"), spark.createDataFrame(SPEAKERS, "speaker_id int, full_name string, speaker_role string")).collect()
    assert [r["speaker_id"] for r in got] == ([who] if who else [])
    assert brute.speaker_of(label, SPEAKERS) == who


def test_turns(spark):
    segs = [(1, 0, 0.0, "00:00:00 MARROW: um, hello [LAUGHTER]"), (1, 1, 2.0, "there. >> Student: Why? >> ILSE: So."), (1, 2, 1.0, "and Keshwick said"), (1, 3, 3.0, "Note: this, at 10:30 with Tobin."), (1, 4, 3.0, None), (1, 5, None, "<v Tobin>Bye"), (2, 0, 0.0, ""), (2, 1, 1.0, "nobody")]
    s = payloads(spark, segs)
    p = spark.createDataFrame(SPEAKERS, "speaker_id int, full_name string, speaker_role string")
    assert rows(turns.turn_starts(s, p)) == [(1, 0, 1), (1, 1, 1), (1, 1, 3), (1, 5, 2)]
    got = turns.speaker_turns(s, p).orderBy("raw_id", "turn").select("raw_id", "speaker_id", "first_index", "start_ms", "words").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 0, "hello and Keshwick said there."), (1, 3, 1, 2000, "Why?"), (1, 1, 1, 2000, "So. Note: this, at with Tobin."), (1, 2, 5, None, "Bye"), (2, None, 1, 1000, "nobody")]
    assert turns.turn_starts(s.limit(0), p).count() == 0 == turns.turn_starts(s, p.limit(0)).count()
    # the same where the labels don't go to all tasks
    assert rows(turns.turn_starts(s, p, most_labels=0)) == rows(turns.turn_starts(s, p))
    assert turns.speaker_turns(s, p, most_labels=0).exceptAll(turns.speaker_turns(s, p)).isEmpty()


def test_turns_in_captions_of_round_brackets_notes_and_dashes(spark):
    segs = ["(Student) x", "(applause)", "we go on (laughs) here", "\u266a x \u266a", "- and on - and on.\n\u2013 Yes", "(Tobin) y", "So. - Marrow: z", "(SIDE CONVERSATION)", "well-known", "\u266b"]
    s = payloads(spark, [(1, i, float(i), t) for i, t in enumerate(segs)])
    p = spark.createDataFrame(SPEAKERS, "speaker_id int, full_name string, speaker_role string")
    assert rows(turns.turn_starts(s, p)) == [(1, 0, 3), (1, 5, 2), (1, 6, 1)]
    got = turns.speaker_turns(s, p).orderBy("turn").select("speaker_id", "first_index", "words").collect()
    assert [tuple(r) for r in got] == [(3, 0, "x we go on here x and on - and on. Yes"), (2, 5, "y So."), (1, 6, "z well-known")]


def test_turns_keep_spoken_words_in_brackets(spark):
    segs = ["at 10:30 (see figure two) we go on", "now (see figure two) we go on", "(see figure two)", "an array a[i] of [LAUGHTER] it (laughs) [00:01:02] ( 0:10 ) (?)", "[MUSIC PLAYING] yes", "[students laugh and clap loudly] ( 0:10 ) so"]
    s = payloads(spark, [(1, i, float(i), t) for i, t in enumerate(segs)])
    p = spark.createDataFrame(SPEAKERS, "speaker_id int, full_name string, speaker_role string")
    got = turns.speaker_turns(s, p).select("words").collect()
    assert [r["words"] for r in got] == ["at (see figure two) we go on now (see figure two) we go on (see figure two) an array a [i] of it yes so"]


# --- 8 packing


def check_windows(docs, got, capacity):
    fill, parts = {}, {}
    for r in got:
        fill.setdefault(r["window"], []).append(r)
        parts.setdefault(r["doc_id"], []).append(r)
    for w in fill.values():
        assert sum(r["tokens"] for r in w) == w[0]["fill"] <= capacity
    sizes = {i: n for i, _, n in docs if n}
    assert set(parts) == set(sizes)
    for i, ps in parts.items():
        assert sum(r["tokens"] for r in ps) == sizes[i] and (len(ps) == 1 or sizes[i] > capacity)
        assert sorted(r["piece"] for r in ps) == list(range(len(ps)))
    return fill


@pytest.mark.parametrize("shard", [10_000_000, 20_000])
def test_windows(spark, shard):
    rnd = random.Random(8)
    docs = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([0, 1, 7, 50, 99, 100, 101, 250, 300])) for i in range(1500)] + [(5000, "c", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    got = packing.pack(df, 100, shard_tokens=shard).collect()
    fill = check_windows([d for d in docs if d[2]], got, 100)
    total = sum(d[2] or 0 for d in docs)
    assert len(fill) <= 1.2 * total / 100


def test_mixture_is_held(spark):
    docs = [(i, "ab"[i % 2], 10) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), 100, shard_tokens=5000).collect()
    fill = check_windows(docs, got, 100)
    mixed = [sum(r["source"] == "a" for r in w) for w in fill.values()]
    assert sum(4 <= m <= 6 for m in mixed) > 0.95 * len(mixed)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")).count() == 0


def test_shards_stay_bounded_where_nothing_combines(spark):
    docs = [(i, "abc"[i % 3], 51 + i % 46) for i in range(800)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), 100, shard_tokens=7000).collect()
    assert len(check_windows(docs, got, 100)) == len(docs)
    held = {}
    for r in got:
        shard = r["window"].rsplit("-", 1)[0]
        held[shard] = held.get(shard, 0) + r["tokens"]
    assert max(held.values()) < 2 * 7000


def test_no_round_outgrows_the_bound_where_windows_stay_open(spark, monkeypatch):
    held, one_round = [], packing._round
    def watched(items, shares, shards, *rest):
        held.append(items.withColumn("s", F.pmod(F.xxhash64("item", F.lit(rest[1])), F.lit(shards))).groupBy("s").count().agg(F.max("count")).first()[0])
        return one_round(items, shares, shards, *rest)
    monkeypatch.setattr(packing, "_round", watched)
    df = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit(60).cast("bigint").alias("tokens"))
    got = packing.pack(df, 100, shard_items=500)
    assert got.select("window").distinct().count() == 8000 and max(held) < 2 * 500


def test_mixture_and_its_distance(spark):
    docs = [(i, "a" if i % 4 else "b", 10) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, target double")
    near = {r["source"]: r for r in packing.mixture(packing.pack(df, 100, shard_tokens=5000), targets, 100).collect()}
    assert near["a"]["share"] == 0.75 and near["a"]["filled"] > 0.98 and near["a"]["mean_distance"] < 0.1
    lone = spark.createDataFrame([("w1", 1, 0, "a", 10, 10), ("w2", 2, 0, "b", 10, 10)], "window string, doc_id bigint, piece int, source string, tokens bigint, fill bigint")
    assert [r["mean_distance"] for r in packing.mixture(lone, targets, 10).orderBy("source").collect()] == [0.5, 0.5]
    assert packing.tempered({"a": 900, "b": 100}, 0.5) == {"a": 0.75, "b": 0.25}


def test_deficits_go_from_round_to_round(spark, monkeypatch):
    rnd, carries, one_round = random.Random(88), [], packing._round
    monkeypatch.setattr(packing, "_round", lambda *a: carries.append(a[-1]) or one_round(*a))
    docs = [(i, "a" if i % 4 else "b", rnd.choice([5, 10, 20, 50]) if i % 4 else rnd.choice([10, 67])) for i in range(1500)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), 100, shard_tokens=5000).collect()
    check_windows(docs, got, 100)
    first = [r for r in got if r["window"].startswith("1-")]
    share = sum(n for _, s, n in docs if s == "a") / sum(n for *_, n in docs)
    owed = share * sum(r["tokens"] for r in first) - sum(r["tokens"] for r in first if r["source"] == "a")
    assert len(carries) > 1 and carries[0] == {"a": 0.0, "b": 0.0}
    assert carries[1]["a"] == pytest.approx(owed) == pytest.approx(-carries[1]["b"]) and abs(owed) > 1
    # what is owed is given first
    items = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(40)], "item bigint, source string, tokens bigint")
    held = one_round(items, {"a": 0.5, "b": 0.5}, 1, 100, 2, {"a": 100.0, "b": -100.0}).where("window = '2-0-0'")
    assert {r["source"] for r in held.collect()} == {"a"}


# --- 9 leaks

PASSAGE = "the one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_leaks(spark):
    w = PASSAGE.split()
    cut = " ".join(w[:5]) + " [LAUGHTER] um, " + " ".join(w[5:8]).upper() + " (0:00:30)\n" + " ".join(w[8:12]) + " 00:01:02.500 " + "—".join(w[12:])
    docs = [(1, PASSAGE), (1, "another text of the same id"), (10, cut.replace("[LAUGHTER]", "[students laugh and clap loudly]")), (2, cut), (3, " ".join(w[:11])), (4, None), (5, ""), (6, "x " + " ".join(w[1:13]).replace("e", "е")), (7, " ".join(w[:6]) + " (Fig. 2.1) " + " ".join(w[6:])), (8, PASSAGE), (9, " ".join(w[8:] + ["pause"] + w[:8]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    p = spark.createDataFrame([("q1", "a", PASSAGE), ("q2", "a", "short one"), ("q3", "a", None), ("q4", "b", PASSAGE)], "item string, passage string, text string").where("text is not null")
    got = leaks.leaks(d, p)
    assert {(r["doc_id"], r["item"]) for r in got.where("longest >= 12").collect()} == {(i, q) for i in (1, 2, 6, 8, 10) for q in ("q1", "q4")}
    # the same without sending the seeds to the tasks
    assert got.exceptAll(leaks.leaks(d, p, most_seeds=0)).isEmpty() and leaks.leaks(d, p, most_seeds=0).count() == got.count()
    parts = leaks.leaks(d, p, seed=6).where("doc_id = 9 and item = 'q1'").first()
    assert parts["tiles"] == 2 and parts["covered"] == 15 == parts["passage_words"]
    assert leaks.leaks(d.limit(0), p).count() == 0 == leaks.leaks(d, p.limit(0)).count()


def test_tiling_is_greedy():
    t, p = (np.array([ord(c) for c in s], np.uint64) for s in ("abcdXefghabc", "efghabcd"))
    assert sorted(leaks.tile(t, p, 3)) == [(5, 0, 7)]
    t, p = (np.array([ord(c) for c in s], np.uint64) for s in ("abcdeXabc", "abcabcde"))
    assert sorted(leaks.tile(t, p, 3)) == [(0, 3, 5), (6, 0, 3)]
    assert leaks.tile(t[:2], p, 3) == [] == leaks.tile(t, p[:0], 3)


def plain_tiles(text, pattern, least):
    """One longest common stretch at a time, by trying every pair of places."""
    used_t, used_p, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for p in range(len(pattern)):
                n = 0
                while a + n < len(text) and p + n < len(pattern) and text[a + n] == pattern[p + n] and a + n not in used_t and p + n not in used_p:
                    n += 1
                if n > best[2]:
                    best = (a, p, n)
        if best[2] < least:
            return out
        out.append(best)
        used_t |= set(range(best[0], best[0] + best[2]))
        used_p |= set(range(best[1], best[1] + best[2]))


def test_tiling_against_every_pair_of_places():
    rnd = random.Random(99)
    for _ in range(150):
        text, pattern = ([rnd.choice("abcd"[: rnd.randrange(1, 5)]) for _ in range(rnd.randrange(0, 30))] for _ in range(2))
        got = leaks.tile(*(np.array([ord(c) for c in x], np.uint64) for x in (text, pattern)), 3)
        assert [(a, p, n) for a, p, n in got] == plain_tiles(text, pattern, 3)


def test_tiling_of_repetitive_texts_is_quick():
    import time

    began = time.time()
    assert leaks.tile(np.full(20_000, 7, np.uint64), np.full(400, 7, np.uint64), 12) == [(0, 0, 400)]
    rnd = np.random.default_rng(5)
    t = leaks.tile(rnd.integers(0, 2, 20_000).astype(np.uint64), rnd.integers(0, 2, 2000).astype(np.uint64), 6)
    assert t[0][2] >= t[-1][2] >= 6 and time.time() - began < 5


# --- 10 reading


NONE = languages.profiles([], np.zeros((0, languages.BUCKETS)))


def test_ranks_and_coverage(spark):
    docs = [(1, "a a a b", "x"), (2, "a b c 12", "x"), (3, None, "x"), (4, "", "x"), (5, "7 8", "x"), (6, "a a a a a a a a a d", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, rank string")
    nobody = spark.createDataFrame([], "doc_id bigint, grade int")
    got = {r["doc_id"]: r for r in reading.measured(df, nobody, NONE, share=0.9).collect()}
    # a 13, b 2, c and d 1 each
    assert [got[i]["coverage_rank"] for i in range(1, 7)] == [2, 3, None, None, None, 1]
    assert got[2]["words"] == 3 and got[5]["words"] == 0 and got[1]["rank_input"] == "x"
    for head in (0, 1, 2):
        few = {r["doc_id"]: r["coverage_rank"] for r in reading.measured(df, nobody, NONE, share=0.9, head=head).collect()}
        assert few == {i: r["coverage_rank"] for i, r in got.items()}
    none = reading.levels(df, nobody, NONE)
    assert {r["doc_id"]: r["grade"] for r in none.collect()} == {1: 8.5, 2: 8.5, 3: None, 4: None, 5: None, 6: 8.5}
    assert reading.levels(df.limit(0), nobody, NONE).count() == 0


def test_ranks_of_many_counts(spark):
    """Against a plain ranking: one more than the words of the language with a larger count, of which twelve binary digits are compared."""
    rnd = random.Random(10)
    data = [(rnd.choice(["en", "ru"]), i, int(2 ** rnd.uniform(0, 50))) for i in range(3000)] + [("en", 9000 + i, 7) for i in range(5)]
    coarse = lambda n: n >> max(0, n.bit_length() - 12) << max(0, n.bit_length() - 12)
    got = {r["word"]: (r["rank"], r["through"]) for r in reading.ranks(spark.createDataFrame(data, "language string, word bigint, n bigint")).collect()}
    for lang, w, n in data[::37] + data[-5:]:
        mine = [coarse(x[2]) for x in data if x[0] == lang]
        assert got[w] == (1 + sum(x > coarse(n) for x in mine), sum(x >= coarse(n) for x in mine))


def test_characters_are_words_where_no_blanks_are_written(spark):
    df = spark.createDataFrame([(1, "我们走。我们看！"), (2, "one two. three")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in reading.counted(df, NONE).collect()}
    assert (got[1]["words"], got[1]["sentences"], len(got[1]["vocabulary"]), sorted(got[1]["uses"])) == (6, 2, 4, [1, 1, 2, 2])
    assert (got[2]["words"], got[2]["sentences"]) == (3, 2)


@needs_data
def test_grades_of_documents_not_seen(spark):
    """Held out: the formula is near the raters, and without the coverage rank it is clearly worse."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/reading_labels.parquet")
    seen, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0 and grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("y"))
    m = reading.measured(docs.drop("lang"), seen, languages.fitted(docs.select("text", F.col("lang").alias("label")))).cache()
    c = reading.calibrate(m, seen)
    off = F.avg(F.abs(F.col("p") - F.col("y")))
    full, corr = m.withColumn("p", reading.formula(c)).join(held, "doc_id").agg(off, F.corr("p", "y")).first()
    without = m.withColumn("p", reading.formula(reading.calibrate(m, seen, reading.SENTENCE_TERMS), reading.SENTENCE_TERMS)).join(held, "doc_id").agg(off).first()[0]
    print("mean error", full, "without rank", without, "correlation", corr, dict(zip(reading.TERMS, c)))
    assert full < 1.25 and corr > 0.9 and without > full + 0.25 and c[list(reading.TERMS).index("log_rank")] > 1


# --- all


@needs_data
@needs_tokenizers
@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p6_found", "p7_found", "p9_found"])
def test_found_against_brute_force(spark, name):
    t = {n: [r.asDict(True) for r in spark.read.parquet(f"{SF}/{n}.parquet").collect()] for n in {"p1_found": ["chunks"], "p4_found": ["transcripts", "transcripts_raw"], "p6_found": ["transcripts_raw"], "p7_found": ["transcripts_raw", "speakers"], "p9_found": ["documents", "eval_questions"]}[name]}
    pick = lambda n, *c: [tuple(r[x] for x in c) for r in t[n]]
    want = {
        "p1_found": lambda: brute.p1(pick("chunks", "chunk_id", "chunk_text")),
        "p4_found": lambda: brute.p4(pick("transcripts", "transcript_id", "video_id", "raw_text"), pick("transcripts_raw", "raw_id", "video_id", "segments")),
        "p6_found": lambda: brute.p6(pick("transcripts_raw", "raw_id", "segments")),
        "p7_found": lambda: brute.p7(pick("transcripts_raw", "raw_id", "segments"), pick("speakers", "speaker_id", "full_name", "speaker_role")),
        "p9_found": lambda: brute.p9(pick("documents", "doc_id", "text"), pick("eval_questions", "question_id", "question", "expected_answer_points")),
    }[name]()
    assert {tuple(r) for r in catalogue.queries()[name](spark, SF).collect()} == want


@needs_data
@needs_tokenizers
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - {"p1_found", "p4_found", "p6_found", "p7_found", "p9_found"}))
def test_runs_through(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
