"""The corpus operators against brute force, round trips and held-out labels, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, common, fingerprints, near_copies, packing, personal, quality, queries, sharding, tiling, toxicity, url_filter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, bucket int"


def odd_documents(spark):
    """Nulls, an empty, a blank and a very long text, ties, repeated rows, and columns named like inner ones."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (4, "two words"), (None, None), (None, "no id at all, but text here"),
            (5, long), (6, long), (7, "Same text with some more words in it, twice."), (8, "Same text with some more words in it, twice."), (7, None)]
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 3, "x", 1) for i, t in rows], DOCS)


def documents(spark, sf=SF):
    return common.load(spark, sf, "documents")


def texts(spark, sf=SF):
    return [(r["doc_id"], r["text"] or "") for r in documents(spark, sf).select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


def test_hot_keys_of_a_join_are_salted(spark):
    rows = spark.range(9_000).select("id", F.when(F.col("id") < 3_000, -1).when(F.col("id") < 3_010, F.lit(None)).otherwise(F.col("id") % 2_500).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).where("k <> 5")
    want = sorted(map(tuple, rows.join(facts, "k").select("id", "k", "n", "s").collect()))
    got = common.attach(rows, facts, ["k"], 9_000)
    assert got.columns == ["id", "k", "n", "s"] and sorted(map(tuple, got.collect())) == want
    assert common.attach(rows.limit(0), facts.limit(0), ["k"], 0).count() == 0


def test_components_with_a_hub(spark):
    edges = [(0, k) for k in range(1, 3_000)] + [(9_000, k) for k in range(4_000, 5_000)] + [(9_500, 9_500)] + [(6_000 + k, 6_001 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(3_000)}, **{k: 4_000 for k in (*range(4_000, 5_000), 9_000)}, **{k: 6_000 for k in range(6_000, 6_041)}}
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# chat

def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<|", "a<", "|>", "<|endoftext|>", "ünï 日本 \ud7ff 👍🏽", "", "\\<|\n\r\t\x00"]
    for t in nasty:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    rows = [(1, k, r, t) for k, t in enumerate(nasty) for r in ("assistant",)] + [(2, None, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "a<|im_sep|>", "<|im_sep|>")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, ids int, loss int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.assemble(df)).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(nasty).encode()).hexdigest() and got[1]["loss_chars"] == len("".join(nasty))
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[None]["n_turns"] == 2
    assert got[3]["turns_sha256"] == hashlib.sha256(b"a<|im_sep|>\n<|im_sep|>\n").hexdigest() and got[3]["loss_chars"] == 0
    turns = chat.assemble(df).where("conv_id = 1").orderBy("turn_index").collect()
    assert [t["token_start"] for t in turns] == np.append(0, np.cumsum([len(t["ids"]) for t in turns])[:-1]).tolist()
    assert chat.read_back(chat.assemble(df.limit(0))).count() == 0


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(3)
    made = ["".join(draw.choice("ab1290.@-+ ()%_é\n") for _ in range(draw.randrange(80))) for _ in range(4000)]
    made += ["4111 1111-1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (202) 555-0100.", "x@y", "٣.1.2.3.4", "999.1.1.1", "0001.1.1.1"]
    for t in made + [t for _, t in texts(spark)]:
        assert [(personal.KINDS[k], a, b) for k, a, b in personal.base_spans(t)] == plain_base(t), repr(t)


def test_personal_data_query(spark):
    got = {r["doc_id"]: r for r in queries.op2_personal_data(spark, SF).collect()}
    for i, t in texts(spark):
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t))
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        spans = set(got[i]["spans"].split(",")) - {""}
        assert {s for s in line.split(",") if s} <= spans and len(spans) - got[i]["n_more"] == len([s for s in line.split(",") if s])


def test_secrets_are_learned_and_masked(spark):
    rows = [(k, f"ordinary prose number{k} and chapter2section{k}") for k in range(60)]
    rows += [(100 + k, f"the password={hashlib.md5(str(k).encode()).hexdigest()} ok") for k in range(30)] + [(200, "mail me: a.b@c.org now"), (201, None)]
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, found string, n_chars int")
    found = {r["doc_id"]: r for r in personal.find(df).collect()}
    assert all(found[100 + k]["n_more"] == 1 for k in range(30)) and all(found[k]["n_more"] == 0 for k in range(60))
    out = {r["doc_id"]: r for r in personal.redact(df).collect()}
    assert out[100]["text"] == "the password=[SECRET] ok" and out[200]["text"] == "mail me: [EMAIL] now" and out[201]["text"] is None
    assert out[0]["text"] == rows[0][1] and out[200]["n_chars"] == len(out[200]["text"]) and out[0]["found"] == "n"


@pytest.mark.parametrize("text, name", [('{"name":"Peter Schmidt","age":4}', "Peter Schmidt"), ("seen (Laura Braun, Bonn)", "Laura Braun"), ("contact:Hans Weber", "Hans Weber"),
                                        ("[Marie Curie]", "Marie Curie"), ("Anna-Petra Vogel", "Petra Vogel"), ("«José Ortega»", "José Ortega")])
def test_names_after_punctuation_are_proposed(text, name):
    at = text.index(name)
    assert (personal.NAME, at, at + len(name)) in [c[:3] for c in personal.candidates(text, personal.base_spans(text))]
    pattern = personal.candidates(text, [])[0][3]
    assert personal.mask(text, frozenset([pattern])) == text.replace(name, "[NAME]")


def test_estimation_tells_labelers_apart():
    counts = {"5|+++0|000": 80, "5|++00|000": 20, "5|00--|000": 300, "5|0+0-|000": 40, "5|0000|000": 30}
    right, rates = personal.estimate(counts)
    assert right["5|+++0|000"] > 0.95 and right["5|00--|000"] < 0.05
    assert rates[5, 0, 1]["+"] > rates[5, 0, 0]["+"]


# classifiers

@pytest.mark.parametrize("score, label, parts, out, least", [(toxicity.score, "toxic", 5, 0, 0.9), (quality.score, "quality", 3, 1, 0.97)])
def test_held_out_accuracy(spark, score, label, parts, out, least):
    sf = "/root/testdata/sf0.1" if Path("/root/testdata/sf0.1").exists() else SF
    labels = common.load(spark, sf, "labels")
    got = score(documents(spark, sf), labels)
    assert got.count() == documents(spark, sf).count()
    seen = got.join(labels, "doc_id").where("held_out").select("predicted", label, "doc_id", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % parts == out and 0 <= r["score"] <= 1 for r in seen)
    assert np.mean([r["predicted"] == r[label] for r in seen]) > least
    by = {c: [r["predicted"] == c for r in seen if r[label] == c] for c in (0, 1)}
    assert min(np.mean(by[0]), np.mean(by[1])) > (0.8 if least < 0.95 else 0.9)


@pytest.mark.parametrize("score, label", [(toxicity.score, "toxic"), (quality.score, "quality")])
def test_classifiers_on_odd_input(spark, score, label):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (7, 0, 1), (7, 1, 0), (5, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        got = score(docs, marks).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert score(docs.limit(0), labels).count() == 0


def test_a_repeated_id_is_one_example(spark, monkeypatch):
    docs = documents(spark)
    one = common.load(spark, SF, "labels").where("quality in (0, 1) and toxic in (0, 1) and doc_id % 3 <> 1").orderBy("doc_id").first()["doc_id"]
    again = docs.where(F.col("doc_id") == one)
    many = docs.unionByName(again.crossJoin(spark.range(400).select())).unionByName(again.withColumn("text", F.concat("text", F.lit(" and more"))))
    labels, sizes, fits = common.load(spark, SF, "labels"), [], (quality.fit, toxicity._fit)
    monkeypatch.setattr(quality, "fit", lambda x, y: (sizes.append(len(y)), fits[0](x, y))[1])
    monkeypatch.setattr(toxicity, "_fit", lambda x, y: (sizes.append(len(y)), fits[1](x, y))[1])
    for score, of in ((quality.score, {"parts": 3, "held_out": 9}), (toxicity.score, {"parts": 5, "held_out": 9})):
        sizes.clear()
        score(docs, labels, **of).count(), score(many, labels, **of).count()
        assert sizes[0] == sizes[1] > 0


def test_all_cues_that_pass_are_kept(spark):
    words = [" ".join(f"w{k}x" for k in range(6_000)), "plain text here"]
    examples = spark.createDataFrame([(f"{words[0]} {n}n", 1) for n in range(40)] + [(f"{words[1]} {n}n", 0) for n in range(40)], "text string, y int")
    assert {f"w{k}x$" for k in range(6_000)} <= set(toxicity.learn_cues(examples))


def test_grammar_hears_clauses():
    machine = toxicity.MACHINE
    end = lambda *classes: machine.say[[s := 0, *[s := machine.step[s][c] for c in classes]][-1]]  # noqa: E731, F841
    t = toxicity
    assert end(t.TARGET, t.INSULT) == (1, 0, 1, 0, 0)
    assert end(t.NEGATION, t.INSULT) == (1, 0, 0, 1, 0) and end(t.INSULT, t.NEGATION) == (1, 0, 0, 0, 0)
    assert end(t.REPORT, t.OTHER, t.INSULT) == (1, 0, 0, 0, 1) and end(t.THREAT, t.TARGET) == (0, 1, 1, 0, 0)


# decontamination

def test_tiles_are_greedy():
    item, text = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9]), np.array([5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 0, 5, 6, 7, 8])
    assert tiling.tile(text, item, 4) == [(0, 4, 5), (6, 0, 4)]
    draw = random.Random(1)
    for _ in range(150):
        a, b = [np.array([draw.randrange(1, 4) for _ in range(draw.randrange(1, 25))]) for _ in range(2)]
        assert tiling.tile(a, b, 3) == plain_tiles(a.tolist(), b.tolist(), 3)


def plain_tiles(a, b, least):
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(least, min(len(a) - i, len(b) - j) + 1)
                    if a[i:i + n] == b[j:j + n] and not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))), default=None)
        if best is None:
            return tiles
        n, i, j = best[0], -best[1], -best[2]
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        tiles.append((i, j, n))


def test_decontamination_finds_planted_items(spark, monkeypatch):
    bench = common.load(spark, SF, "benchmark").collect()
    words = bench[0]["text"].split()
    half = len(words) // 2
    planted = [(1, "x y z " + bench[0]["text"] + " p q"), (2, " ".join([*words[half:], "between", *words[:half]])), (3, " ".join(words[:half - 3])), (4, "nothing of it"), (5, None), (5, None)]
    df = spark.createDataFrame([(i, t, "c", "k") for i, t in planted], "doc_id long, text string, coverage string, extra string")
    benchmark = common.load(spark, SF, "benchmark").unionByName(spark.createDataFrame([(900, None), (901, "too short")], "item_id long, text string"))
    for chars in (tiling.BLOCK_CHARS, 2000):
        monkeypatch.setattr(tiling, "BLOCK_CHARS", chars)
        got = {r["doc_id"]: r for r in tiling.split(df, benchmark).collect()}
        assert got[1]["contaminated"] and got[1]["coverage"] == 1 and got[1]["item_id"] == bench[0]["item_id"] and got[1]["extra"] == "k"
        assert got[2]["contaminated"] and not got[3]["contaminated"] and not got[4]["contaminated"] and got[5]["coverage"] == 0 and got[5]["item_id"] is None
    assert tiling.split(df, benchmark.limit(0)).where("contaminated").count() == 0 and tiling.split(df.limit(0), benchmark).count() == 0


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Who wrote Don Quixote?"), (2, "What is the capital of France?"), (3, "two words"), (4, "How many legs does a spider have?")]
    rows = [(1, "he asked: who wrote don quixote, and when"), (2, "What is the capital of all France?"), (3, "two words"), (4, "what is the capital of France, how many legs does a spider have"), (5, "who wrote don"), (6, None)]
    df, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["coverage"], r["item_id"], r["n_items"]) for r in tiling.split(df, benchmark).collect()}
    assert got == {1: (True, 1.0, 1, 1), 4: (True, 1.0, 2, 2), **{k: (False, 0.0, None, 0) for k in (2, 3, 5, 6)}}


def test_decontamination_query_against_brute_force(spark):
    items = [(r["item_id"], tiling.words_of(r["text"])) for r in common.load(spark, SF, "benchmark").collect()]
    got = {r["doc_id"]: r for r in queries.op4_decontaminate(spark, SF).collect()}
    for i, t in texts(spark):
        words, best = tiling.words_of(t), 0.0
        number = {w: k + 1 for k, w in enumerate(set(words))}
        for _, item in items:
            a, b = np.array([number[w] for w in words]), np.array([number.get(w, -k - 1) for k, w in enumerate(item)])
            if len(set(item) & set(words)) >= 4 and len(a) < 3000:
                best = max(best, sum(n for _, _, n in tiling.tile(a, b)) / len(item))
        if len(words) < 3000:
            assert got[i]["contaminated"] == (best >= tiling.THRESHOLD) and got[i]["coverage"] == pytest.approx(best if best >= tiling.THRESHOLD else 0.0)


# url rules

def test_url_rules_by_trie_and_by_joins(spark, monkeypatch):
    urls = [None, "", "no scheme/x", "http://A.Example.ORG/en/12?x", "https://example.org/es/", "http://xexample.org/es/q", "http://org", "http://org/", "ftp://b.com/de/fr/#/x",
            "http://c.com/fr/é", "http://c.com?/fr/", "http://c.com:80/fr/", "x://y://z.org/a", "http://d.com/de", "http://É.com/de/"] * 2
    rules = spark.createDataFrame([*queries.RULES, ("org", "/", "block"), ("e.org", "/en", "allow"), (None, "/", "block"), ("com", "", "maybe")], "host string, path string, verdict string")
    df = spark.createDataFrame([(k, u, "old", "kept") for k, u in enumerate(urls)], "page_id long, url string, host string, judged string")
    by_trie = sorted(map(tuple, url_filter.judge(df, rules).collect()))
    by_joins = sorted(map(tuple, url_filter.judge_by_joins(df, rules.where("host is not null and verdict in ('allow', 'block')"), "url", "allow").select("page_id", "url", "judged", "host", "path", "rule", "verdict").collect()))
    assert by_trie == by_joins and len(by_trie) == len(urls)
    monkeypatch.setattr(url_filter, "MAX_RULES", 1)
    assert sorted(map(tuple, url_filter.judge(df, rules).select("page_id", "url", "judged", "host", "path", "rule", "verdict").collect())) == by_trie
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, rules.limit(0), default="block").collect()} == {"block"}


# sharding

@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even_and_gapless(spark, hot):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", F.lit(1).alias("key"), F.lit(2).alias("range"))
    if hot:  # one text has half of the rows
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("copied " * 300)).otherwise(F.col("text")))
    got = sharding.shard(docs).collect()
    source = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(source)
    sizes, slots = np.zeros(8), [[] for _ in range(8)]
    for r in got:
        data = source[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(data) + 1, zlib.crc32(data), None, "bytes")
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sizes.max() - sizes.min() <= 2 * max(r["size"] for r in got) + 0.02 * sizes.mean()


def test_a_text_of_many_rows_and_few_bytes_is_parted(spark, monkeypatch):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.repeat("text", 3)).alias("text"))
    cells, settled = [], sharding.settle
    def spy(df):
        out = settled(df)
        if {"range", "sub"} <= set(df.columns):
            cells.append(out.orderBy("rows_before").select("rows_before").toPandas()["rows_before"].tolist())
        return out
    monkeypatch.setattr(sharding, "settle", spy)
    got, n = sharding.shard(docs).collect(), docs.count()
    assert max(np.diff([*cells[0], n])) < n / 20  # the rows of one cell are sorted by one task
    assert len({r["shard"] for r in got if r["size"] == 1}) == 1 and sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect())
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_sharding_odd_input(spark):
    docs = odd_documents(spark)
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count() and sum(r["size"] == 1 for r in got) == 4
    assert sharding.shard(docs.limit(0)).count() == 0
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# near copies

def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_links(rows):
    sets = [shingles(t) for _, t in rows]
    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    near = {frozenset(p) for ks in by.values() for p in combinations(ks, 2)} | {frozenset(p) for p in combinations([k for k, s in enumerate(sets) if not s], 2)}
    return [tuple(p) for p in near if (lambda a, b: (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0)(*(sets[k] for k in p))]


def near_rows(spark):
    draw, rows = random.Random(5), [(i, t) for i, t in texts(spark) if len(t) < 6000]
    base = [f"w{draw.randrange(4000)}" for _ in range(120)]
    for k in range(70):  # a group of near copies in a chain of edits, with copies of some
        if k % 5:
            base[draw.randrange(120)] = f"e{k}"
        rows.append((10_000 + k, " ".join(base)))
    return rows + [(20_000, ""), (20_001, " "), (20_002, "One two"), (20_003, "one  TWO")]


def test_near_copies_against_brute_force(spark, monkeypatch):
    rows = near_rows(spark)
    linked = plain_links(rows)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in linked:
        n[a], n[b] = n[a] + 1, n[b] + 1
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    want = {rows[k][0]: (n[k], min(groups[root(k)])) for k in range(len(rows))}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, root string, copies int")
    for block in (near_copies.BLOCK_SHINGLES, 900):
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", block)
        got = {r["doc_id"]: (r["n_links"], r["group_id"]) for r in near_copies.join(df).collect()}
        assert got == want
    for blocks in ((near_copies.BLOCK_SHINGLES, near_copies.BLOCK_CLASSES), (900, 3)):
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", blocks[0])
        monkeypatch.setattr(near_copies, "BLOCK_CLASSES", blocks[1])
        kept = near_copies.keep_one(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({min(g) for g in groups.values()})


def test_near_copies_odd_input(spark):
    docs = odd_documents(spark)
    got = near_copies.join(docs).collect()
    assert len(got) == docs.count()
    assert sorted(r["n_links"] for r in got if r["doc_id"] in (4,)) == [0, 1, 1] and {r["class_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    kept = near_copies.keep_one(docs).collect()
    assert sorted((r["text"] or "").strip()[:9] for r in kept) == ["", "Same text", "no id at ", "one", "two words", "word0 and"]
    assert near_copies.join(docs.limit(0)).count() == 0 and near_copies.keep_one(docs.limit(0)).count() == 0
    assert near_copies.choose_bands() == 18 and 1 - (1 - 0.8 ** 4) ** 18 >= 0.9999


# fingerprints

def test_fingerprints_against_brute_force(spark):
    rows = sorted(texts(spark), reverse=True)
    make = fingerprints.hasher()
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    marks = {i: make(t) for i, t in rows}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{marks[i]:016x}")
        assert r["edited_fingerprint"] == f"{make(edited):016x}" and r["near_next"] == fingerprints.likeness(marks[i], make(after))
        assert r["n_copies"] == sum(m == marks[i] for m in marks.values()) - 1
        assert r["n_near"] == sum(0 < (m ^ marks[i]).bit_count() <= 3 for m in marks.values())
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_block_tables_find_all(spark, monkeypatch):
    draw = random.Random(2)
    marks = {draw.getrandbits(64) for _ in range(40)}
    for m in list(marks):
        for _ in range(12):
            x = m
            for b in draw.sample(range(64), draw.randrange(1, 6)):
                x ^= 1 << b
            marks.add(x)
    df = spark.createDataFrame([(f"{m:016x}", 1 + m % 3) for m in marks], "fingerprint string, copies long")
    want = {f"{m:016x}": (sum(1 + o % 3 for o in marks if 0 < (m ^ o).bit_count() <= 3), sum(0 < (m ^ o).bit_count() <= 3 for o in marks)) for m in marks}
    for block in (fingerprints.BLOCK, 5):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        got = {r["fingerprint"]: (r["n_near"], r["n_near_marks"]) for r in fingerprints.near(df).collect()}
        assert got == {k: v for k, v in want.items() if v[1]}


def test_near_copies_lie_within_the_wide_radius(spark):
    make, sets = fingerprints.hasher(), {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts(spark))}
    marks = {i: make(t) for i, t in texts(spark)}
    got = {r["doc_id"]: r["n_wide"] for r in queries.op9_fingerprints(spark, SF).collect()}
    assert got == {i: sum(0 < (m ^ o).bit_count() <= 9 for o in marks.values()) for i, m in marks.items()}
    alike = [(a, b) for a, b in combinations(sets, 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert alike and all(0 < (marks[a] ^ marks[b]).bit_count() <= 9 and got[a] and got[b] for a, b in alike)


def test_wide_block_tables_find_all(spark, monkeypatch):
    draw = random.Random(3)
    marks = {draw.getrandbits(64) for _ in range(8)}
    for m in list(marks):
        for _ in range(12):
            marks.add(m ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 13))))
    df = spark.createDataFrame([(f"{m:016x}", 1 + m % 3) for m in marks], "fingerprint string, copies long")
    count = lambda m, r: sum(1 + o % 3 for o in marks if 0 < (m ^ o).bit_count() <= r)
    want = {f"{m:016x}": (count(m, 3), count(m, 9)) for m in marks if count(m, 9)}
    for blocks, block in ((10, 4096), (10, 5), (11, 5), (None, 4096)):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        got = {r["fingerprint"]: (r["n_near"], r["n_wide"]) for r in fingerprints.near(df, blocks=blocks, wide=9).collect()}
        assert got == want
    assert fingerprints.blocks_for(10_000, 9) < fingerprints.blocks_for(10_000_000, 9)


def test_fingerprints_odd_input(spark, monkeypatch):
    docs = odd_documents(spark)
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 3)
    got = fingerprints.search(docs).collect()
    assert len(got) == docs.count() and all(r["fingerprint"] == "0" * 16 for r in got if r["n_chars"] == 0)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert fingerprints.search(docs.limit(0)).count() == 0
    assert fingerprints.search(docs.where("doc_id = 5")).count() == 1


# packing

def test_packing(spark):
    path = packing.Encoder(None).tok
    got = queries.op10_pack(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts(spark):
        ids, parts = [*path.encode(t, add_special_tokens=False).ids, 1], sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == [(k, min(4096, len(ids) - k)) for k in range(0, len(ids), 4096)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for r in parts)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.append(0, np.cumsum([r["length"] for r in rows]))[:-1].tolist() and sum(r["length"] for r in rows) <= 4096
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 4096) + 2


def test_plan_places_every_piece_once():
    draw = random.Random(4)
    for capacity in (1, 2, 7, 40):
        for _ in range(60):
            histogram = {n: draw.randrange(0, 9) for n in range(1, capacity + 1)}
            made, seen, fill = packing.plan(histogram, capacity), {}, {}
            for length, first, n, per, sequence, offset in made.rows:
                for k in range(n):
                    seen.setdefault(length, []).append(first + k)
                    fill.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
            assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items() if n}
            for parts in fill.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= capacity


def test_words_are_encoded_as_texts():
    draw, encode = random.Random(6), packing.Encoder(None)
    for t in ["don't stop's 'RE", "İ. ΣΑΣ, x", "<|endoftext|>", "ﬁ ǅ. 日本。", "", " ", *("".join(draw.choice("aÉß'., \n1\u0301İΣς<|>日k\u0308\u0958") for _ in range(40)) for _ in range(500))]:
        assert encode([t])[0] == np.array(encode.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_marks_behind_words_are_learned_apart(monkeypatch):
    monkeypatch.setattr(packing, "GENERATION", 20)
    draw, encode = random.Random(7), packing.Encoder(None)
    encode(["Abc*** abc&&&\t\tABC.) abc"])
    assert {"abc", "***", "&&&", ".)"} <= set(encode.young)
    for t in ["ΣΑΣ***", "don't*** é***'s", "a<|endoftext|>*", *("".join(draw.choice("aÉß'., \n\t\r\x0b\x1c*$-<|>\u0301İΣ1T") for _ in range(40)) for _ in range(500))]:
        assert encode([t])[0] == np.array(encode.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing_odd_input(spark):
    docs = odd_documents(spark)
    got = packing.pack(docs).collect()
    assert sum(r["length"] == 1 for r in got) == 5 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(docs.limit(0)).count() == 0


# the pipeline

def test_pipeline_against_stages(spark):
    docs = documents(spark)
    labels = common.load(spark, SF, "labels")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    good = [(i, t) for i, t in texts(spark) if scores[i] >= 0.5]
    assert sorted(r["doc_id"] for r in corpus_pipeline.good(spark, docs, SF).collect()) == sorted(i for i, _ in good)
    groups = {r["doc_id"]: r["group_id"] for r in near_copies.join(docs.where(F.col("doc_id").isin([i for i, _ in good]))).collect()}
    leaks = {r["doc_id"] for r in tiling.split(docs, common.load(spark, SF, "benchmark")).where("contaminated").collect()}
    kept = {i for i, _ in good if groups[i] == i and i not in leaks}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept


def test_stages_on_odd_input(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert sorted(stage(spark, docs, SF).columns) == sorted(docs.columns), name
            assert stage(spark, docs, SF).count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
