from __future__ import annotations

import corpus_pipeline
from gridlark.llm import mixing, neardup, packing, secrets, toxicity

from .test_neardup import brute_groups
from .test_packing import check

SMALL = "/root/testdata/sf0.001"


def test_stages_are_the_given_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage on plain Python rows, decided by brute-force versions (the trained model's scores are taken as they
    are), and the packed pieces of what is left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    rows = [r.asDict() for r in docs.collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = [r for r in rows if score[r["doc_id"]] < toxicity.THRESHOLD]
    clean = [r for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(r in kept for r in clean) >= 0.97 * len(clean)
    kept.sort(key=lambda r: r["doc_id"])
    kept = [kept[g] for g in sorted(set(brute_groups([r["text"] or "" for r in kept])))]
    for r in kept:
        for _, s, e in reversed(secrets.find_spans(r["text"] or "")):
            r["text"] = r["text"][:s] + "[SECRET]" + r["text"][e:]
    plan = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(kept, docs.schema)).collect()}
    texts = []
    for r in kept:
        p, words = plan[r["doc_id"]], (r["text"] or "").split()
        if not p["size"]:
            texts.append((r["doc_id"], r["text"]))
            continue
        texts += [(r["doc_id"], r["text"])] * (p["taken"] // p["size"])
        if p["taken"] % p["size"]:
            texts.append((r["doc_id"], " ".join(words[: p["taken"] % p["size"]])))
    check(corpus_pipeline.run(spark, SMALL).collect(), texts, packing.CAPACITY)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.names == docs.schema.names


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_near_copies_go_once(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(1, text), (2, text), (3, text.upper()), (4, "other words are here")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in neardup.one_of_each(spark, docs, SMALL).collect()) == [1, 4]


def test_mixing_decides_each_row_by_itself(spark):
    """Rows without a doc_id, or that share one, each have their own share of the mix; no row's words get lost."""
    five = "one two three four five"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in [(None, ""), (None, five), (None, "six " * 40), (3, five), (3, "seven eight"), (3, "")]], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed(spark, docs, SMALL).collect()
    assert sum(not r["text"] for r in out) == 2
    assert sum(len(r["text"].split()) for r in out) == 52 * 3 // 2
    assert {r["text"].split()[0] for r in out if r["text"]} == {"one", "six", "seven"}


def test_stages_take_nulls_and_clashing_columns(spark):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "some words here", None, None, 15, "c"), (3, "token = abcdef123 and more words", "en", "s", 30, "d"), (4, "w " * 50_000, "en", "hot", 100_000, "e")]
    names = ("toxicity", "key", "size", "taken", "part", "n", "spans", "fp", "score", "rank", "bucket", "length", "component_id")
    docs = spark.createDataFrame([(*r[:5], *[r[5]] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() >= 1
        assert all(len({r[n] for n in names}) == 1 for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 5
