import hashlib

import sentencepiece
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_suffix_dedup import brute as cut_brute

import corpus_pipeline as P
from codegauge.llm.common import documents

FUNCS = dict(P.STAGES)
Q, J, S, M, T = (f for _, f in P.STAGES)


def reread(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_stages_against_brute_force(spark, tmp_path):
    docs = documents(spark, SF)
    kept = reread(spark, Q(spark, docs, SF), tmp_path, "q")
    assert kept.columns == docs.columns and 0.75 * docs.count() < kept.count() < docs.count()
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id").join(kept, "doc_id", "left_anti").count()
    assert bad <= 2

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = reread(spark, J(spark, kept, SF), tmp_path, "j")
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c in components(rows, 5, 80, 100) if d == c)

    cut = reread(spark, S(spark, one, SF), tmp_path, "s")
    want = {d: n - m for d, n, m, _, _ in cut_brute([(r.doc_id, r.text) for r in one.collect()])}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and all(len(got[d].text.encode()) >= n for d, n in want.items() if d in got)
    assert all(got[d].n_chars == len(got[d].text) for d in got) and all(n < 50 for d, n in want.items() if d not in got)

    mix = reread(spark, M(spark, cut, SF), tmp_path, "m")
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    words = {r.doc_id: len((r.text or "").split()) for r in cut.collect()}
    assert set(counts.values()) <= {1, 2} and abs(sum(words[d] * c for d, c in counts.items()) / (1.5 * sum(words.values())) - 1) < 0.1

    out = T(spark, mix, SF).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=P.public_tokenizers.path(P.MODEL))
    texts = {r.doc_id: r.text or "" for r in mix.collect()}
    assert len(out) == mix.count()
    for r in out[:80]:
        ids = lib.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, out))


def test_odd_rows_and_clashing_names(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd.drop("n_chars").withColumn("a.b", F.lit(1)).withColumn("tile", F.lit(2)).withColumn("code", F.lit(3)).withColumn("bits", F.lit(4))), ("none", none)):
        columns = docs.columns
        for k, (_, f) in enumerate(P.STAGES):
            docs = reread(spark, f(spark, docs, SF), tmp_path, f"{name}{k}")
            if k < 4:
                assert docs.columns == columns
        assert (docs.count() == 0) == (name == "none")


def test_registered():
    import __spark_entry__ as e
    assert e.queries()["pipeline"] is P.run and "pipeline" not in e.oracle_sql()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in e.queries() if k.startswith("op")}


def mixed(spark, order, tmp_path, name):
    """Null and shared ids, equal sizes, under one order of the input."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(7)).alias("doc_id"), F.concat(F.lit("one two w"), F.col("id").cast("string")).alias("text"),
                                   F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    return reread(spark, rows.orderBy(order).coalesce(1), tmp_path, name)


def test_mix_agrees_under_any_order(spark, tmp_path):
    one, two = (sorted(r.text for r in M(spark, mixed(spark, o, tmp_path, n), SF).collect()) for o, n in ((F.col("id").desc(), "a"), (F.xxhash64("id"), "b")))
    assert one == two and len(one) > len(set(one))


def test_shared_ids_lose_no_unlinked_text(spark, tmp_path):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue white black grey", None, ""]
    rows = [(5, t, "en", "s", k) for k, t in enumerate(texts)] + [(9, texts[1], "en", "s", 10), (1, texts[3], "en", "s", 11), (None, texts[0], "en", "s", 12), (None, texts[0], "en", "s", 13)]
    docs = reread(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int"), tmp_path, "d")
    got = sorted(((r.doc_id or -1, r.text or "") for r in J(spark, docs, SF).collect()))
    # equal texts of id 5 are one; 'one two' stays under 9, 'red green' under 1: smaller than the numbers of shared ids; null ids stay
    assert got == sorted([(5, texts[0]), (9, texts[1]), (1, texts[3]), (5, ""), (5, ""), (-1, texts[0]), (-1, texts[0])])
