"""The corpus operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from decimal import Decimal, localcontext

import numpy as np
import public_tokenizers as tokenizers_files
import pytest
from pyspark.sql import functions as F

from callweave.llm import bpe, common, components, matroska, minhash, mixing, quality_mil, quality_rules, sharding, shingles, token_counts, url_filter, warc
from callweave.llm.queries import WEIGHTS

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "b"),
    (3, None, "a"),
    (4, "", None),
    (5, " \n\t ", "a"),
    (6, "Don't  stop\n\n\nnow   é 世界 \u00a0 12345 #!? end ", "a"),
    (7, "x" * 5000 + " " + "ab" * 700, "a"),
    (8, "word " * 3000, "a"),
    (None, "a row without an id", "a"),
    (9, "two words", "a"),
    (9, "two words", "a"),
    (10, "<|endoftext|> special <|endoftext|>", "a"),
]
#: Every name that an operator gives to a column of its own.
CLASHING = "at no name slot shard group u n part copy_no mix_key stats votes quality kept Score held_out digest digest_row copy_id copy_digest keep row rep values text_a text_b region component_id n_shingles media ids decoded n_bytes".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(*r, 1, 2, "v", 3, *["w"] * len(CLASHING)) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id int, label int, node string, n_tokens int, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


def test_shards_take_turns_and_keep_keys(spark, odd, empty):
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert set(table) == {0, 1, 2} and max(table.count(i) for i in range(3)) - min(table.count(i) for i in range(3)) <= 1
    out = sharding.assign_shards(odd, "doc_id", ["a", "b", "c"], 101)
    assert out.count() == len(ODD) and sharding.assign_shards(empty, "doc_id", ["a"], 101).count() == 0
    for r in out.collect():
        slot = int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard_no"]) == (slot, table[slot])
    fewer = sharding.lookup_table(["a", "b"], 101)
    assert sum(x != y for x, y in zip(table, fewer) if x != 2) <= 12


def test_bpe_equals_tiktoken_and_decodes(odd, empty, documents):
    import tiktoken

    path = tokenizers_files.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for df in (odd, documents):
        got = bpe.round_trip(df, path, tokenizers_files.PATTERN, with_ids=True)
        texts = {(r["doc_id"], r["text"] or "") for r in df.collect()}
        want = sorted((str(i), len(ids := enc.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
        assert sorted({(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()}) == want
        assert got.count() == df.count()
    assert bpe.round_trip(empty, path, tokenizers_files.PATTERN).count() == 0
    coded = bpe.encode_texts(odd, path, tokenizers_files.PATTERN)
    decoded = {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode_ids(coded, path, tokenizers_files.PATTERN).collect()}
    assert decoded == {(i, (t or "").encode()) for i, t, _ in ODD}


def test_token_counts_equal_the_library(odd, empty, documents):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for df in (odd, documents):
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(own.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, path).collect()) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_archives_round_trip(spark):
    long = "é<p>" * 60_000
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "\r\n\r\n" * 400), (8, "u", "\r\n\r\n" * 400), (8, "u", "\r\n\r\n" * 400), (None, "u", long)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(df).collect()
    assert len(got) == len(rows)
    found = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    best = {1: 2, None: 2, 7: 8}
    assert found == {(i, size(t), sha(t), "revisit" if i in best else "response", best.get(i)) for i, _, t in rows}
    assert warc.archive_round_trip(df.where("false")).count() == 0
    archive = warc.write_archive(df)
    assert archive.agg(F.max(F.length("data"))).first()[0] < warc.CHUNK + 2000 and archive.where("chunk_no > 2").count() > 0
    raw = b"".join(bytes(r["data"]) for r in archive.orderBy("seq", "chunk_no").collect())
    n = 0
    while raw:  # as any reader of WARC files
        head, _, raw = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        raw = raw[int(fields[b"Content-Length"]) :]
        assert head.startswith(b"WARC/1.1\r\n") and raw.startswith(b"\r\n\r\n")
        raw, n = raw[4:], n + 1
    assert n == len(rows)


def test_mixture_means_and_counts(spark, odd, empty):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit("t").alias("text"), F.lit(9).alias("copy_no"))
    out = mixing.mix(df, {"hot": 1.0, "b": 3.0, mixing.OTHERS: 2.0})
    share = {r["source"]: r["count"] / 30_000 for r in out.groupBy("source").count().collect()}
    assert share["hot"] == pytest.approx(1 / 6, abs=0.02) and share["b"] == pytest.approx(0.5, abs=0.02) and share[None] == pytest.approx(1 / 3, abs=0.02)
    assert out.columns == ["doc_id", "source", "text", "copy_no", "mix_key"] and out.agg(F.min("copy_no")).first()[0] == 1
    assert sorted(out.select("mix_key").rdd.map(tuple).collect()) == sorted(mixing.mix(df.repartition(7), {"hot": 1.0, "b": 3.0, mixing.OTHERS: 2.0}).select("mix_key").rdd.map(tuple).collect())
    steps = mixing.poisson_steps(2.0)
    assert steps[0] == pytest.approx(np.exp(-2)) and steps[-1] == pytest.approx(1)
    assert mixing.mix(empty, {"a": 1.0}).count() == 0 and mixing.mix(odd, {"a": 1.0}).count() > 0


def poisson_quantile(mean, u):
    """The count whose cumulative probability first exceeds ``u``, in 60 digits."""
    with localcontext() as c:
        c.prec = 60
        k, term = 0, (-Decimal(mean)).exp()
        total = term
        while total <= Decimal(u):
            k += 1
            term *= Decimal(mean) / k
            total += term
        return k


def test_a_rare_source_gets_its_copies(spark):
    rows = [(i, f"src{i % 20}" if i else None) for i in range(10_000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), WEIGHTS)
    u = int(hashlib.md5(b"mix-1//0").hexdigest()[:13], 16) / 2**52
    rare = sorted(r["copy_no"] for r in out.where("source is null").collect())
    assert rare == list(range(1, poisson_quantile(450.0, u) + 1)) and 350 < len(rare) < 550
    others = out.where("source is not null").count()
    assert 9_000 < others < 10_000


def test_poisson_tables_of_any_mean(spark, monkeypatch):
    rng = random.Random(5)
    for mean in (0.0, 0.3, 20.0, 50.0, 63.9, 64.0, 64.1, 450.0, 5000.0):
        first, steps = mixing.poisson_table(mean)
        for u in (2.0**-52, 1e-9, 0.5, 1 - 1e-9, *(rng.random() for _ in range(10))):
            assert first + sum(x <= u for x in steps) == poisson_quantile(mean, u), (mean, u)
    first, steps = mixing.poisson_table(4.5e7)
    assert 4.5e7 - 1e5 < first and len(steps) < 200_000 and abs(first + sum(x <= 0.5 for x in steps) - 4.5e7) < 2
    with pytest.raises(ValueError):
        mixing.poisson_table(-1.0)
    monkeypatch.setattr(mixing, "LISTED", 7)
    df = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, source string")
    by = {}
    for r in mixing.replicate(df, {"a": 70.0}).collect():
        by.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert all(sorted(c) == list(range(1, poisson_quantile(70.0, int(hashlib.md5(f"mix-1/a/{i}".encode()).hexdigest()[:13], 16) / 2**52) + 1)) for i, c in by.items()) and len(by) == 20


def test_classifier_on_held_out_documents(spark, odd, empty):
    rng = random.Random(1)
    words = ["river", "stone", "about", "under", "light", "house", "green", "small"]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(words).upper() + "!!" for _ in range(n))
    rows = [(i, good(120) if i % 4 else good(60) + " " + bad(60)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = by_id(quality_mil.quality_scores(df, labels))
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in got.values() if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.95
    scores = quality_mil.quality_scores(odd, labels).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality_mil.quality_scores(empty, labels).count() == 0
    assert quality_mil.quality_scores(odd, labels.where("false")).count() == len(ODD)


def test_passages_cover_whole_texts():
    text = "A b! c\n" * 100
    data = np.frombuffer(text.encode(), np.uint8)
    x, owner = quality_mil.passages(data, np.array([0, len(data)]))
    assert len(x) == -(-300 // quality_mil.PASSAGE_WORDS) and set(owner) == {0}
    x, owner = quality_mil.passages(np.zeros(0, np.uint8), np.array([0, 0]))
    assert x.shape == (1, quality_mil.FEATURES) and not x.any()


def sets_of(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute_components(rows, size, percent):
    sets = [(i, sets_of(t, size)) for i, t in rows]
    label = {k: k for k in range(len(sets))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def near_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(300):  # a large group on the threshold's edge
        text = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(300, 420):
        text = [rng.choice(words) for _ in range(rng.choice((1, 2, 3, 40, 90)))]
        rows += [(i, " ".join(text)), (i + 1000, " ".join(text[:-1] + ["Other"])), (i + 2000, " ".join(text).upper())]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size=size, percent=percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_near_duplicates_compare_cut_regions(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 2)
    test_near_duplicates_equal_brute_force(spark, 3, 85)


def test_near_duplicates_of_odd_rows(odd, empty, spark):
    got = minhash.near_duplicates(odd, size=3, percent=85).collect()
    assert len(got) == len(ODD) and minhash.near_duplicates(empty).count() == 0
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got}
    assert found[1] == (1, True) and found[2] == (1, False) and found[3] == (3, True) and found[5] == (5, True) and found[None] == (None, False)
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {None, *range(1, 11)} - {2}


def test_copies_are_dropped_by_row_not_by_id(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = text["a"].replace("a59", "other")
    rows = [
        (3, text["a"], "x"), (7, text["b"], "x"), (7, near, "x"), (8, text["c"], "y"), (8, text["c"], "x"), (8, text["c"], "x"),
        (None, text["d"], "x"), (None, text["d"], "x"), (None, text["a"], "x"), (None, text["e"], "x"), (9, text["e"], "x"),
        (5, "", "x"), (5, "", "x"), (5, None, "x"), (6, text["f"], "x"), (6, text["f"].upper(), "x"),
    ]
    want = [(3, text["a"], "x"), (7, text["b"], "x"), (8, text["c"], "x"), (None, text["d"], "x"), (9, text["e"], "x"), (5, "", "x"), (5, "", "x"), (5, None, "x")]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        got = sorted(map(str, map(tuple, minhash.drop_near_duplicates(df).collect())))
        upper = [g for g in got if g.startswith("(6,")]
        assert len(upper) == 1 and sorted(set(got) - set(upper)) == sorted({str(w) for w in want}) and len(got) == len(want) + 1


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(600)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5), (7, 8)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for one_task in (0, 10_000):
        got = {r["node"]: r["label"] for r in components.components(df, one_task).collect()}
        assert got == {i: 0 for i in range(601)} | {1000 + i: 1000 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_counts_of_any_text():
    import pyarrow as pa

    texts = ["", "One", "one two", "A b C d a B c d", "é\u00a0x\u2003y  z\x0bq", "w " * 50]
    for size in (3, 5):
        found = [len(s) for _, data, starts in shingles.runs(pa.array(texts), 16) for s in shingles.shingle_sets(data, starts, size)]
        assert found == [len(sets_of(t, size)) for t in texts]


def test_rule_counts_equal_brute_force(odd, empty, documents):
    for df in (odd, documents):
        got = quality_rules.quality_rules(df).collect()
        assert len(got) == df.count()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in got:
            text = texts[r["doc_id"]]
            words = re.findall("[^\x20\x09-\x0d]+", text)
            windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            often = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else None
            lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
            assert r["n_symbols"] == len(re.findall("[#*$%&|<>]", text))
            if often is not None:
                assert r["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if w in often for k in range(5)})
            failed = len(words) < 10 or 100 * r["n_repeat_words"] > 20 * len(words)
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("prior", [0.5, 0.8])
def test_label_model_finds_rates_and_prior(prior):
    rng = np.random.default_rng(2)
    good = rng.random(60_000) < prior
    rates = [((0.6, 0.1), (0.1, 0.5)), ((0.7, 0.0), (0.3, 0.0)), ((0.0, 0.05), (0.0, 0.6)), ((0.0, 0.02), (0.0, 0.4)), ((0.5, 0.1), (0.1, 0.7))]
    columns = []
    for of_good, of_bad in rates:
        u = rng.random(60_000)
        up, down = (np.where(good, g, b) for g, b in zip(of_good, of_bad, strict=True))
        columns.append(np.where(u < up, 1, np.where(u < up + down, -1, 0)))
    found, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    model = quality_rules.fit([(tuple(v), int(c)) for v, c in zip(found.tolist(), n, strict=True)], 5)
    assert model.prior == pytest.approx(prior, abs=0.03)
    assert np.allclose(model.good, [g for g, _ in rates], atol=0.03) and np.allclose(model.bad, [b for _, b in rates], atol=0.03)
    assert all(model.weights(i)[1] >= 0 >= model.weights(i)[-1] for i in range(5))
    assert quality_rules.fit([], 3).prior == 0.8


def test_rows_kept_by_the_rules(odd, documents):
    for df in (odd, documents):
        judged = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.quality_rules(df).collect()}
        left = quality_rules.keep_good(df)
        assert left.columns == df.columns
        want = sorted(str(r["doc_id"]) for r in df.collect() if judged[r["doc_id"], len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))])
        assert sorted(str(r["doc_id"]) for r in left.collect()) == want


def test_names_never_clash(odd):
    model = quality_mil.fit([np.zeros((1, quality_mil.FEATURES), np.float32)], np.ones(1, np.float32))
    kept = ("slot", "shard", "copy_no", "mix_key")
    assert set(sharding.assign_shards(odd, "doc_id", ["a", "b"], 101).columns) == {*odd.columns, "shard_no"}
    assert mixing.mix(odd, {"a": 1.0}).columns == [c for c in odd.columns if c not in kept[2:]] + ["copy_no", "mix_key"]
    assert quality_mil.keep_predicted(odd, model).columns == odd.columns and quality_mil.keep_predicted(odd, model).count() >= 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert minhash.drop_near_duplicates(odd).columns == odd.columns


def long_words(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [
        lambda n: "".join(rng.choice(letters) for _ in range(n)),
        lambda n: "".join(rng.choice("ab") for _ in range(n)),
        lambda n: ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) * n)[:n],
        lambda n: "".join(rng.choice("=-*_#'") for _ in range(n)),
        lambda n: "".join(rng.choice("éüйцук世界۳") for _ in range(n)),
        lambda n: rng.choice("=a -é世") * n,
    ]
    return [rng.choice(kinds)(rng.randrange(49, 400)) for _ in range(n)] + ["a" * 20_001, "=" * 5011, "ab" * 4001, kinds[0](20_000), "世界" * 3000]


def test_long_words_equal_tiktoken():
    import pyarrow as pa
    import tiktoken

    path = tokenizers_files.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own, texts = bpe.Codec(path, tokenizers_files.PATTERN), long_words(random.Random(9), 600)
    got = []
    for _, data, starts in shingles.runs(pa.array(texts), 1 << 16):
        ids, at = own.encode(data, starts)
        assert own.decode(ids, at) == [data[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [enc.encode_ordinary(t) for t in texts]
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=200_000)).encode()
    begin = time.process_time()
    ids, _ = own.encode(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    assert ids.tolist() == enc.encode_ordinary(word.decode()) and time.process_time() - begin < 40


def test_pieces_never_change_counts(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    own, counter, rng = Tokenizer.from_file(path), token_counts.PieceCounter(path), random.Random(5)
    pool = ["a", "b1", "'s", "'", " ", "\n", "  ", "\t", "\r\n", "<|endoftext|>", "<|", "|>", "é", "世", "。", "，", " ", " ", " ", "\x1c", "\x85", "!", "!'", "x!", "9", "٣", "'S", "don't", "Ä", "\u0301", "\ufeff", "😀", "_", "|", "\u3000", "\u2003", "ABC", "$%", "\u200b"]
    monkeypatch.setattr(token_counts, "LONG", 300)
    texts = ["".join(rng.choice(pool) for _ in range(rng.choice((3, 10, 40, 400)))) for _ in range(2000)]
    texts += ["".join(rng.choice(pool) for _ in range(1500)).translate({i: None for i in range(33)}) for _ in range(50)] + long_words(rng, 100)
    got = [n for _, data, starts in shingles.runs(pa.array(texts), 1 << 18) for n in counter.counts(data, starts).tolist()]
    assert got == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


LARGE = """
import resource, sys
import numpy as np, pyarrow as pa, public_tokenizers as files
from callweave.llm import bpe, matroska, quality_mil, quality_rules, shingles, token_counts
kind = sys.argv[1]
tools = {
    "bpe": lambda c=bpe.Codec(files.path("byte_bpe_50k.tiktoken"), files.PATTERN): lambda d, s: c.decode(*c.encode(d, s)),
    "counts": lambda c=token_counts.PieceCounter(files.path("byte_bpe_50k.json")): c.counts,
    "classifier": lambda m=quality_mil.fit([np.ones((2, quality_mil.FEATURES), np.float32)], np.ones(1, np.float32)): m.score,
    "rules": lambda: quality_rules.text_stats,
    "sketch": lambda: lambda d, s: shingles.signatures(shingles.shingle_sets(d, s, 5)),
    "media": lambda: lambda d, s: list(matroska.described(matroska.packet_rows(0, len(d), matroska.write(matroska.padded(d.tobytes().decode())[0])))),
}
run = tools[kind]()
texts = ["word number %d of a line\\n" % (i % 5000) for i in range(5000)]
for k in (1, 160):
    for _, data, starts in shingles.runs(pa.array(["".join(texts) * k])):
        run(data, starts)
    if k == 1:
        base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("kind", ["bpe", "counts", "classifier", "rules", "sketch", "media"])
def test_memory_of_one_text_of_20_megabytes(kind):
    out = subprocess.run([sys.executable, "-c", LARGE, kind], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert int(out.stdout) < 700


def test_urls_are_judged_exactly(spark):
    rng = random.Random(4)
    urls = ["http://x.EXAMPLE.net/en/1?q#f", "https://net/", "http://net", "ftp://a.example.com/de/x", "x://a.org/fr/?u=http://b.net/", "no scheme", "", None, "http://", "http://aexample.net/en/", "http://h.bad.io:80/", "http://h.bad.io/p", "http://net.org/fr"]
    urls += [f"http://h{rng.randrange(900)}.s{rng.randrange(30)}.com/{rng.choice(('en', 'de', 'x'))}/{i}" for i in range(3000)]
    listed = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("hosts", "bad.io"), *[("block", f"h{i}.s{i % 30}.com/de/") for i in range(0, 900, 3)], *[("allow", f"s{i}.com/x/") for i in range(30)]]
    df = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, h1 int")
    got = by_id(url_filter.judge_urls(df, spark.createDataFrame(listed, "list string, key string")), "page_id")
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [(len(h), len(p), k, a) for a, k in listed if a != "hosts" for h, p in [(k[: k.index("/")], k[k.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, action = max(fits)[2:] if fits else (None, "block" if host == "bad.io" or host.endswith(".bad.io") else "allow")
        assert tuple(got[i])[1:] == (host, path, rule, action), url
    assert url_filter.judge_urls(df.where("false"), spark.createDataFrame(listed, "list string, key string")).count() == 0


def test_cascades_of_several_levels_are_exact(spark):
    asked = spark.range(40_000).select(F.concat(F.lit("h"), F.col("id") % 30_000, F.lit(".com")).alias("key"))
    listed = spark.range(0, 30_000, 7).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("key")).unionByName(spark.range(2000).select(F.concat(F.lit("never"), "id").alias("key")))
    scratch = common.Scratch(spark)
    seed, levels = url_filter.cascade(asked, listed, scratch)
    assert len(levels) >= 3 and [x.number for x in levels] == list(range(len(levels)))
    keys = asked.distinct().select("key", *url_filter._hashes(F.col("key"), seed)).toPandas()
    found = url_filter.contains(levels, keys["h1"].to_numpy(), keys["h2"].to_numpy())
    assert found.tolist() == [int(k[1:-4]) % 7 == 0 for k in keys["key"]]
    scratch.drop()
    assert not [p for p in scratch.paths if os.path.exists(p)]


def test_a_short_list_among_many_keys_needs_few_levels(spark):
    asked = spark.range(30_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("key"))
    listed = spark.createDataFrame([("a", "h7.com"), ("a", "h9.com"), ("b", "h9.com"), ("b", "x.org")], "list string, key string")
    scratch = common.Scratch(spark)
    seed, levels = url_filter.cascades(asked, listed, scratch)
    assert seed == 0 and all(len(x) <= 5 for x in levels.values())
    keys = asked.select("key", *url_filter._hashes(F.col("key"), seed)).toPandas()
    for name, own in (("a", {"h7.com", "h9.com"}), ("b", {"h9.com"})):
        assert set(keys["key"][url_filter.contains(levels[name], keys["h1"].to_numpy(), keys["h2"].to_numpy())]) == own
    scratch.drop()


def test_hot_keys_of_joined_lists_are_broadcast(spark, monkeypatch):
    urls = [f"http://s{i}.hot.com/de/{i}" if i % 3 else f"http://t{i}.org/fr/" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    lists = spark.createDataFrame([("block", "com/de/"), ("allow", "s1.hot.com/de/"), ("hosts", "t3.org"), ("hosts", "org"), ("allow", "t6.org/")], "list string, key string")
    want = sorted(map(str, url_filter.judge_urls(df, lists).collect()))
    monkeypatch.setattr(url_filter, "MOST_BITS", 8)
    assert sorted(map(str, url_filter.judge_urls(df, lists).collect())) == want and sum("block" in w for w in want) == 2998


def test_lists_too_large_for_filters_are_joined(spark, monkeypatch):
    urls = ["http://a.net/en/x", "http://b.example.net/en/x", "http://x.bad.io/", "http://ok.io/", None, "http://b.example.net/fr"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    lists = spark.createDataFrame([("block", "net/"), ("allow", "example.net/en/"), ("hosts", "bad.io")], "list string, key string")
    want = sorted(map(str, url_filter.judge_urls(df, lists).collect()))
    monkeypatch.setattr(url_filter, "MOST_BITS", 8)
    assert sorted(map(str, url_filter.judge_urls(df, lists).collect())) == want and sum("block" in w for w in want) == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    session = type("S", (), {"conf": type("C", (), {"get": lambda *a: None})(), "sparkContext": type("X", (), {"getCheckpointDir": lambda *a: None, "master": "spark://host"})()})
    with pytest.raises(RuntimeError):
        common.shared_path(session, "x")


def test_media_round_trip_and_foreign_lacing(odd, empty):
    got = matroska.media_features(odd).collect()
    assert len(got) == len(ODD) and matroska.media_features(empty).count() == 0
    texts = {i: (t or "").encode() for i, t, _ in ODD}
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    n = matroska.packet_table(matroska.text_media(odd), "doc_id", "media").agg(F.sum("n_bytes")).first()[0]
    assert n == sum(len(t) + (-len(t) % 64 if t else 64) for t in ((t or "").encode() for _, t, _ in ODD))
    xiph = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 5) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x07\x02" + bytes([2, 255, 45, 1]) + b"a" * 300 + b"b" + b"cc")))
    found = matroska.parse(matroska.HEAD + matroska.element(matroska.SEGMENT, xiph))
    assert [(r[4], r[6]) for r in found.rows] == [(12.0, 300), (12.0, 1), (12.0, 2)]
    with pytest.raises(ValueError):
        matroska.parse(xiph[:40])
