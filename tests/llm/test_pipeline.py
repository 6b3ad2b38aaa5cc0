import corpus_pipeline as C
from tessera.llm import decontam, mixing, neardup, quality
from tessera.llm.common import stage
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, seen = docs.columns, []
    for name, f in C.STAGES:
        before = docs
        docs = stage(f(spark, docs, SF), f"test-{name}")
        seen.append(docs.count())
        ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
        if name == "quality":
            assert ids(docs) == {r["doc_id"] for r in quality.judge_all(before, labels).filter("kept").collect()}
        elif name == "near_duplicates":
            found = brute.near([(r[0], r[1]) for r in before.select("doc_id", "text").collect()], 80)
            assert ids(docs) == {i for i, (_, c) in found.items() if c == i}
        elif name == "decontamination":
            assert ids(docs) == ids(before) - {r[0] for r in decontam.contaminated(before, items).collect()}
        elif name == "mix":
            assert ids(docs) == {r["doc_id"] for r in mixing.mix(before).filter("taken > 0").collect()}
        else:
            assert docs.columns == [*columns, "shard", "slot"] and docs.count() == before.count()
            per = {}
            for r in docs.collect():
                per.setdefault(r["shard"], []).append(r["slot"])
            assert all(sorted(v) == list(range(len(v))) for v in per.values())
        if name != "shard":
            assert docs.columns == columns
    assert C.run(spark, SF).count() == seen[-1]


def test_pipeline_takes_odd_and_empty_documents(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    texts = sorted(((r[0], r[1]) for r in docs.select("doc_id", "text").collect()), key=repr)
    for name, f in C.STAGES:
        columns, before = docs.columns, texts
        docs = stage(f(spark, docs, SF), f"odd-{name}")
        texts = sorted(((r[0], r[1]) for r in docs.select("doc_id", "text").collect()), key=repr)
        if name == "quality":
            # null, empty and short texts go; both rows of id 1 and the one without an id are judged by their words
            judged = [x for x in before if len(brute.WORD.findall(x[1] or "")) >= 10]
            assert set(texts) <= set(judged) and {i for i, _ in judged} == {1, 4, None} and texts.count(texts[0]) == before.count(texts[0])
        elif name in ("near_duplicates", "decontamination"):
            assert texts == before  # rows of one id are one document, no group has two
        elif name == "mix":
            assert set(texts) <= set(before)
        assert docs.columns == (columns if name != "shard" else [*columns, "shard", "slot"])
    own = {}
    for r in docs.collect():
        own.setdefault(r["shard"], []).append(r["slot"])
    assert texts == before and all(sorted(v) == list(range(len(v))) for v in own.values())
    docs = empty
    for name, f in C.STAGES:
        docs = stage(f(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0 and docs.columns == [*empty.columns, *(["shard", "slot"] if name == "shard" else [])]
    assert neardup.drop_near_duplicates(odd).columns == odd.columns
