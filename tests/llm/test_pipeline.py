"""The pipeline's stages on their own input, against brute force, and the whole over odd and empty tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from callweave.llm import bpe, quality_mil, quality_rules
from tests.llm.test_corpus import ODD, SF, brute_components, poisson_quantile


def kept_by_rules(texts):
    """Which texts the rules keep, each counted by itself."""
    raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    stats = [dict(zip(quality_rules.STATS, quality_rules.text_stats(r, np.array([0, len(r)]))[:, 0].tolist(), strict=True)) for r in raw]

    def vote(rule, s):
        ratio = s[rule.over] / max(s[rule.under], 1)
        return -1 if rule.bad and rule.bad[0] <= ratio < rule.bad[1] else 1 if rule.good and rule.good[0] <= ratio < rule.good[1] else 0

    votes = [tuple(vote(r, s) for r in quality_rules.RULES) for s in stats]
    model = quality_rules.fit(list(Counter(votes).items()), len(quality_rules.RULES))
    odds = [np.log(model.prior / (1 - model.prior)) + sum(model.weights(i)[x] for i, x in enumerate(v)) for v in votes]
    return [s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"] and o >= 0 for s, o in zip(stats, odds, strict=True)]


def stage_by_stage(spark, docs, sf_dir):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    model = quality_mil.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for name in list(stages)[:-1]:
        before = docs.collect()
        docs = stages[name](spark, docs, sf_dir).cache()
        assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in before]
        got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "quality_rules":
            want = Counter(r for r, k in zip(rows, kept_by_rules([t for _, t in rows]), strict=True) if k)
        elif name == "quality_classifier":
            raw = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
            want = Counter(r for r, x in zip(rows, raw, strict=True) if model.score(x, np.array([0, len(x)]))[0] >= quality_mil.KEEP)
        elif name == "minhash_near_dedup":
            numbered = [(i, t) for i, (_, t) in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())))]
            keys = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
            found = brute_components(numbered, 5, 80)
            want = Counter({keys[i]: 1 if n else Counter(rows)[keys[i]] for i, (n, c) in found.items() if c == i})
        else:
            named = {s for s in corpus_pipeline.WEIGHTS if s != "*"}
            group = [r["source"] if r["source"] in named else "*" for r in before]
            sizes = Counter(group)
            whole = sum(corpus_pipeline.WEIGHTS[g] for g in sizes)
            want = Counter()
            for r, g in zip(before, group, strict=True):
                u = int(hashlib.md5(f"mix-1/{r['source'] or ''}/{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
                want[r["doc_id"], r["text"]] += poisson_quantile(len(before) * corpus_pipeline.WEIGHTS[g] / whole / sizes[g], u)
            want = +want
        assert got == want, name
    coded = stages["byte_bpe"](spark, docs, sf_dir).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded) == Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    return len(coded)


def test_stages_equal_brute_force(spark):
    assert stage_by_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF) > 100


def test_stages_over_odd_rows(spark, tmp_path):
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "source")
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    text = good.first()["text"]
    again = spark.createDataFrame([(7, text, "src1"), (7, text, "src1"), (None, text, None), (None, text[::-1], None), (7, text + " and more", "src2")], "doc_id long, text string, source string")
    odd = good.unionByName(rows).unionByName(again).withColumns({c: F.lit(1) for c in ("stats", "score", "digest", "keep", "group", "u", "n", "part", "copy_no", "mix_key", "id", "node", "ids")})
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    left = stage_by_stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left > 0


def test_run_over_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
