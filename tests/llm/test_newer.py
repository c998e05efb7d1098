"""The linear tokenizer, the Merkle manifest and whitening against the library and brute force; bounds of the classifier's training."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callweave.llm import linear_bpe, merkle, minhash, quality_mil, queries, shingles, warc, whitening
from callweave.llm.common import Scratch, owned, stored
from tests.llm.test_corpus import ODD, SF, brute_components, empty, odd  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def codec():
    return linear_bpe.codec(TOKENIZER, public_tokenizers.PATTERN)


def encoded(codec, texts):
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    ids, at = codec.encode(np.frombuffer(b"".join(raw), np.uint8), starts)
    assert [d.decode() for d in codec.decode(ids, at)] == texts
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_linear_encoding_equals_the_library(library, codec):
    r = random.Random(1)
    parts = ["a", "b", "e", "t", " ", "the", "ing", "  ", "\n", "é", "世", "1", "22", "'s", "'", "!", "aaaa", "=", "-", SPECIAL, "<|endo", "ftext|>", " ", "　", "\t", "\r\n", "\x1c", "\x85", "՘", "\U0003fc36"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdeinorstuyABT0 ") for _ in range(r.randint(0, 400))) for _ in range(300)]
    texts += [x * n for x in ("a", "ab", "=", " ", "\n", "é", "aab", "0") for n in (1, 2, 3, 7, 31, 64, 257, 1000)]
    texts += ["<|endo", "ftext|>x", "", SPECIAL, SPECIAL * 2, f"a{SPECIAL} b ", f" {SPECIAL}", ""]
    assert encoded(codec, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    some = [f"a{c}b {c} 1{c}" for c in map(chr, range(0, 0x110000, 7)) if not 0xD800 <= ord(c) < 0xE000]
    assert encoded(codec, some) == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_pairs_fit_exactly_if_both_stay(library, codec):
    r = random.Random(2)
    tokens = r.sample(sorted(i for i, n in enumerate(codec.length) if n), 400)
    for a, b in zip(tokens, tokens[1:], strict=False):
        raw = codec.decode(np.array([a, b]), np.array([0, 2]))[0]
        words = [codec.encode_word(raw)]
        assert (np.frombuffer(words[0], "<i4").tolist() == [a, b]) == (codec._first_crossing(a, b) == linear_bpe._NEVER)


def test_long_words_take_linear_time(codec):
    from time import process_time

    def seconds(n):
        start = process_time()
        assert sum(codec.length[i] for i in np.frombuffer(codec.encode_word(b"ab\xc3" * n), "<i4")) == 3 * n
        return process_time() - start

    seconds(1000)
    assert seconds(400_000) < 20 * max(seconds(40_000), 0.01)


def test_linear_round_trip(spark, library, odd, empty):  # noqa: F811
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (odd, documents):
        want = []
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = linear_bpe.round_trip(df, TOKENIZER, public_tokenizers.PATTERN)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == sorted(want)
    assert linear_bpe.round_trip(empty, TOKENIZER, public_tokenizers.PATTERN).count() == 0
    lists = linear_bpe.encode_texts(odd, TOKENIZER, public_tokenizers.PATTERN)
    assert {(r["doc_id"], r["decoded"]) for r in linear_bpe.decode_ids(lists, TOKENIZER, public_tokenizers.PATTERN).collect()} == {(i, t or "") for i, t, _ in ODD}
    broken = spark.createDataFrame([(1, [127, 50256]), (2, None)], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["decoded"]) for r in linear_bpe.decode_ids(broken, TOKENIZER, public_tokenizers.PATTERN).collect()} == {(1, library.decode([127, 50256], skip_special_tokens=False)), (2, "")}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows):
    """The contract's rows from (doc_id, source, lang, n_chars, text)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(said, r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            yield at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""
            at //= 2

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            steps = [*path(trees[g], at), *path(top, k)]
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for right, sibling in steps:
                h = digest(sibling, h) if right else digest(h, sibling)
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(*[s for _, s in steps]), h, h == top[-1][0]


def told(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_manifest_equals_the_definition(spark, height):
    rows = [(1, "s", "b", 3, "x"), (2, None, None, None, None), (None, "s", "b", 3, "y"), (1, "s", "b", 3, "x"), (1, "s", "b", 3, "x"), (5, "é", "a", 2, "日本"), (6, "z", "é", 1, ""), (7, "z", "Z", 1, "t" * 100_000)]
    rows += [(100 + i, "s", "b", i, "w") for i in range(37)]
    names = "doc_id long, source string, lang string, n_chars long, text string, h string, pos string, bucket string, id int"
    df = spark.createDataFrame([(*r, "q", "q", "q", 1) for r in rows], names).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(df, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1)}, height=height)
    assert told(out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified").collect()) == told(manifest_by_hand(rows))
    if height == 12:
        assert merkle.manifest(df.where("false")).count() == 0
        one = merkle.manifest(df.where("doc_id = 6")).first()
        assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == [] and one["verified"]


def test_manifest_of_the_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert told(queries.op12_merkle_manifest(spark, SF).collect()) == told(manifest_by_hand([tuple(r) for r in documents.collect()]))


def check_whitened(got, ids, vectors, components=4):
    x = np.floor(np.array(vectors, float) * 256).astype(int)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - distinct.mean(0)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == len(ids) * min(components, x.shape[1])
    for k in range(min(components, x.shape[1])):
        want = (x - sums / n) @ v[:, k] / np.sqrt(e[k])
        rows = [by[i, k + 1][0] for i in ids]
        value = np.array([r["whitened"] for r in rows])
        assert min(np.abs(value - want).max(), np.abs(value + want).max()) < 1e-9
        assert [r["deviation"] for r in rows] == ((n * x - sums) ** 2).sum(1).tolist() and {r["n"] for r in rows} == {n}
        assert all(abs(r["explained"] - e[k] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9 for r in rows)


def test_whitening_equals_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(queries.op11_chan_whitening(spark, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(0)
    good = [(i, (rng.normal(size=3) * [3, 1, 0.2] - 7).tolist()) for i in range(60)]
    good += [(i, good[0][1]) for i in range(60, 100)]  # a hot vector
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 1.0]), (204, [1.0, 2.0]), (205, []), (206, [1e30, 0.0, 1.0])]
    schema = "vec_id long, embedding array<double>, id string, x string, found string, component string"
    frame = lambda rows: spark.createDataFrame([(*r, *"abcd") for r in rows], schema).repartition(5)
    check_whitened(whitening.whitened(frame(good + bad)).collect(), [i for i, _ in good], [v for _, v in good])
    assert whitening.whitened(frame(bad[:4])).count() == 0 and whitening.whitened(frame(good).where("false")).count() == 0
    alike = whitening.whitened(frame([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in alike] == [(None, 0.0, 0, 0.0)] * 4


def test_deviations_are_exact_where_longs_are_not():
    x = np.array([[1 << 38, -5], [-(1 << 38), 7]])
    for n, sums in ((3, [10, 1]), (1 << 20, [5, -3]), (1 << 30, [-7, 9])):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        assert whitening.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]
    d = np.array([[3 << 55, -(1 << 60) + 5, 12345]])
    assert whitening.squares(d) == [sum(int(v) ** 2 for v in d[0])]


def test_states_merge_like_the_whole():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (500, 4)) + 10_000_000
    whole, parts = whitening.state_of(x), [whitening.state_of(p) for p in np.split(x, [1, 7, 300])]
    merged = parts[0]
    for p in parts[1:]:
        merged = whitening.merged(merged, p)
    assert merged[0] == 500 and merged[1] == whole[1] == x.sum(0).tolist() and np.allclose(merged[3], whole[3], rtol=1e-9) and np.allclose(merged[2], whole[2], rtol=1e-15)


def test_repeats_of_a_labelled_id_cost_one_row(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts = {i: f"text number {i} " + ["good words here", "#### $$$ buy"][i % 2] * 3 for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    many = docs.unionByName(spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a repeat "), "id").alias("text")))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("train", "train")
    try:
        quality_mil.train(many, labels)
        read = [spark.sparkContext._jsc.sc().statusStore().lastStageAttempt(s).resultSize() for j in tracker.getJobIdsForGroup("train") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(read) < 50 << 20


def test_training_on_long_documents_sends_little_to_the_driver(spark):
    """The features of 100 documents of 64 passages are 9 MB; packed bags train the same model as plain ones."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(9999)))), " ")
    docs = spark.range(130).select(F.col("id").alias("doc_id"), words.alias("text")).cache()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long", "long")
    try:
        model = quality_mil.train(docs, labels)
        read = [spark.sparkContext._jsc.sc().statusStore().lastStageAttempt(s).resultSize() for j in tracker.getJobIdsForGroup("long") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(read) < 4 << 20
    known = docs.where(~quality_mil.held_out("doc_id")).orderBy("doc_id").collect()
    plain = quality_mil.fit([quality_mil.bag(np.frombuffer(r["text"].encode(), np.uint8)) for r in known], np.array([r["doc_id"] % 2 for r in known], np.float32))
    assert len(known) > 90 and all(np.array_equal(model.w[k], plain.w[k]) for k in plain.w)
    whole = np.concatenate([quality_mil.bag(np.frombuffer(r["text"].encode(), np.uint8)) for r in known])
    assert np.allclose(model.mean, whole.mean(0, dtype=float), atol=1e-6) and np.allclose(model.scale, np.maximum(whole.std(0, dtype=float), 1e-3), rtol=1e-5)


def forward_by_hand(model, x):
    """The log odds of one text from its passages' features, in plain loops."""
    w = {k: np.asarray(v, float).tolist() for k, v in model.w.items()}
    size, gates = len(w["c"]), len(w["a"])
    hidden, raw = [], []
    for row in x.tolist():
        scaled = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [np.tanh(sum(v * w["enc"][i][j] for i, v in enumerate(scaled)) + w["enc0"][j]) for j in range(size)]
        gate = [np.tanh(sum(h[j] * w["v"][j][g] for j in range(size))) / (1 + np.exp(-sum(h[j] * w["u"][j][g] for j in range(size)))) for g in range(gates)]
        hidden.append(h)
        raw.append(np.exp(sum(a * g for a, g in zip(w["a"], gate, strict=True))))
    z = [sum(r * h[j] for r, h in zip(raw, hidden, strict=True)) / sum(raw) for j in range(size)]
    return sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["c0"]


def test_classifier_equals_plain_loops(spark, monkeypatch):
    model = quality_mil.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(12).collect()] + ["", "one", "word " * 400]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        x, _ = quality_mil.passages(data, np.array([0, len(data)]))
        assert abs(forward_by_hand(model, x) - model.logits(data, np.array([0, len(data)]))[0]) < 1e-3
    long = np.frombuffer(" ".join(texts).encode() * 20, np.uint8)
    whole = model.forward(*quality_mil.passages(long, np.array([0, len(long)])), 1)["logit"][0]
    monkeypatch.setattr(quality_mil, "BLOCK", 4000)
    assert abs(model.logits(long, np.array([0, len(long)]))[0] - whole) < 1e-3
    x, _ = quality_mil.passages(long, np.array([0, len(long)]))
    kept = quality_mil.bag(long)
    step = 1
    while -(-len(x) // step) > quality_mil.BAG:
        step *= 2
    assert np.array_equal(kept, x[::step])


def test_text_ids_of_archives(spark):
    rows = [("a\r\nX-Page-ID: b", "u", "x" * 2000), ("é %41", "u", "x" * 2000), ("z", None, "y")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"a\r\nX-Page-ID: b": ("revisit", "é %41"), "é %41": ("response", None), "z": ("response", None)}


def test_large_payloads_are_read_in_chunks(spark):
    import resource

    sent = "é<p>0123456" * 2_000_000  # 24 MB
    df = spark.createDataFrame([(1, "u", sent), (2, "u", "small")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    raw = sent.encode()
    assert (got[1]["payload_bytes"], got[1]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert Counter(r["record_type"] for r in got.values()) == {"response": 2}
    archive = warc.write_archive(df)
    assert archive.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK + 1000 and resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 1_500_000


def test_tables_of_an_owner_go_with_it(spark):
    scratch = Scratch(spark)
    with owned(scratch):
        inner = stored(spark.range(3).toDF("a"), "inner")
    outer = stored(spark.range(3).toDF("a"), "outer")
    assert inner.count() == 3 and len(scratch.paths) == 1
    scratch.drop()
    assert outer.count() == 3 and not spark._jvm.org.apache.hadoop.fs.Path(inner.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(inner.inputFiles()[0]))


def test_pipeline_leaves_its_last_table_alone(spark):
    import os

    import corpus_pipeline

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before} == {"mixing"}


def test_runs_cover_texts(codec):
    import pyarrow as pa

    texts = pa.array(["ab", None, "", "c" * 50])
    assert [(first, len(starts) - 1) for first, _, starts in shingles.runs(texts, 10)] == [(0, 3), (3, 1)]


#: A file of 64 samples 0 to 63: EBML head, segment with info, one track, one cluster of one unlaced block, one cue.
FIXED = (
    "1a45dfa3a34286810142f7810142f2810442f381084282886d6174726f736b61428781044285810218538067"  # head: version 1, "matroska", type version 4; segment
    "40cd1549a966aa2ad7b1830f424044898840200000000000004d808963616c6c776561766557418963616c6c7765617665"  # a millisecond's scale, 8 ms, writers
    "1654ae6bb9aeb7d7810173c581018381029c810123e3838403d09000868d415f50434d2f494e542f4c4954e191b58840bf4000000000009f810162648108"  # track 1: audio, 64 ms a frame, 8,000 samples of 8 bits
    "1f43b675c9e78100a3c481000080" + bytes(range(64)).hex() + "1c53bb6b8dbb8bb38100b786f78101f1816d"  # cluster at 0, key frame; cue at 0 for byte 109
)


def test_media_have_fixed_bytes_and_features(spark):
    from callweave.llm import matroska

    assert matroska.write(bytes(range(64))).hex() == FIXED
    texts = {1: "".join(map(chr, range(64))), 2: "é" * 30_000, 3: None, 4: "a" * 512 * 8 + "b", 5: "x" * 3_000_000}
    got = {r["doc_id"]: r for r in matroska.media_features(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1]["media_bytes"], got[1]["media_sha256"]) == (len(FIXED) // 2, hashlib.sha256(bytes.fromhex(FIXED)).hexdigest())
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        samples, media = np.frombuffer(payload, np.uint8), matroska.write(payload)
        packets, blocks, clusters = (-(-len(payload) // n) for n in (512, 4096, 32_768))
        loud = sum(abs(int(v) - 128) > 64 for v in samples[:70_000]) if len(samples) <= 70_000 else int((np.abs(samples.astype(int) - 128) > 64).sum())
        told = f"packets={packets};blocks={blocks};clusters={clusters};cues={clusters};ms={len(payload) // 8};sum={int(samples.sum(dtype=np.int64))};mode={min(Counter(payload).items(), key=lambda x: (-x[1], x[0]))[0]};values={len(set(payload))};loud={loud}"
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == told


def unlike_documents(n, seed=1):
    """Texts that share three quarters of their words; a tenth are copies of earlier ones with three words changed."""
    r = random.Random(seed)
    shared, rows = [f"s{i}" for i in range(90)], []
    for i in range(n):
        words = shared + [f"o{r.randrange(10**7)}" for _ in range(30)]
        if i and r.random() < 0.1:
            words = rows[r.randrange(i)][1].split()
            for _ in range(2):
                words[90 + r.randrange(30)] = f"c{r.randrange(10**7)}"
        rows.append((i, " ".join(words)))
    return rows


def test_regions_of_unlike_documents_lose_no_link(spark, monkeypatch, capsys):
    rows = unlike_documents(700)
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {}
    for most in (10, 10_000):  # by rotated orders, and in blocks
        monkeypatch.setattr(minhash, "ODD_ONES", most)
        found[most] = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, size=3, percent=85).collect()}
    linked = [i for i in want if want[i] != i]
    recall = {most: sum(got[i] == want[i] for i in linked) / len(linked) for most, got in found.items()}
    with capsys.disabled():
        print(f"recall of {len(linked)} linked documents in hot regions: by orders {recall[10]:.4f}, in blocks {recall[10_000]:.4f}")
    assert found[10] == found[10_000] == want


def test_parts_of_an_order_are_as_deep_as_it_takes():
    rng = np.random.default_rng(0)
    read = np.sort(rng.integers(0, 3, (400, 6)), axis=0)
    read = read[np.lexsort(read.T[::-1])]
    read[:, 0] = 0
    i, j = minhash.near_in_order(read, 8)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(k, k + 1) for k in range(len(read) - 1)}
    for k in range(len(read)):
        depth = next((d for d in range(1, 6) if (read[:, 1 : d + 1] == read[k, 1 : d + 1]).all(1).sum() <= 8), 5)
        want |= {(k, m) for m in range(k + 1, min(k + 8, len(read))) if (read[m, 1 : depth + 1] == read[k, 1 : depth + 1]).all()}
    assert got == want


def test_shared_members_of_sets_are_counted(monkeypatch):
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (30, 20))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
    for most in (0, 100, 10**6):
        monkeypatch.setattr(minhash, "SINGLY", most)
        assert minhash.common(left, right).tolist() == want
    assert minhash.common([left[0]], [left[0] + np.uint64(99)]).tolist() == [[0]] and minhash.common([], right).shape == (0, 20)


def copies_of_one_text(n, seed=2):
    """Near copies of one text, each changed at places of its own: linked with the text, hardly with each other; every sixth is changed too much."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(4 if i % 6 == 0 else 3 if i % 2 else 2):
            words[r.randrange(120)] = f"c{r.randrange(10**7)}"
        rows.append((i, " ".join(words)))
    return [*rows, (n, " ".join(base))]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_links_of_a_large_group_depend_on_no_size(spark, monkeypatch, size, percent):
    rows = copies_of_one_text(900)
    want = {i: c for i, (_, c) in brute_components(rows, size, percent).items()}
    assert len(set(want.values())) > 30  # some are copies of nothing
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (10, 10_000):
        monkeypatch.setattr(minhash, "ODD_ONES", most)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, size=size, percent=percent).collect()} == want
