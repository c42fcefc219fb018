import re

import corpus_pipeline
from lattica.llm import decontamination, jaccard_join, packing, pii, quality_rules
from lattica.llm.common import read
from lattica.llm.tokens import encoding


def test_pipeline_brute_force(spark, sf):
    """Every stage against its plain version on the same rows."""
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    good = [(d, t) for d, t in docs if kept(t)]
    alone = {d for d, _, c in jaccard_join.brute_force(good) if d == c}
    good = [(d, t) for d, t in good if d in alone]
    dirty = {r[0] for r in decontamination.brute_force(good, items)}
    clean = [(d, pii.brute_force(t, "a key of the test")[0]) for d, t in good if d not in dirty]
    spark.conf.set(pii.SECRET, "a key of the test")
    found = corpus_pipeline.run(spark, sf).collect()
    spark.conf.unset(pii.SECRET)
    assert {r.doc_id: r.doc_tokens for r in found} == {d: len(encoding().encode_ordinary(t)) + 1 for d, t in clean}
    assert sum(r.length for r in found) == sum({r.doc_id: r.doc_tokens for r in found}.values())
    assert max(r.offset + r.length for r in found) <= packing.LENGTH


def kept(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if len(words) < quality_rules.MIN_WORDS:
        return False

    def inside(k):
        at = {}
        for i in range(len(words) - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
        return {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + k)}

    cover = inside(quality_rules.MIN_REPEAT)
    if 100 * len(cover) > quality_rules.MAX_REPEAT_WORDS * len(words) or inside(quality_rules.MAX_LONGEST + 1):
        return False
    return 100 * sum(len(words[j]) for j in cover) <= quality_rules.MAX_COVERED_CHARS * sum(map(len, words))


def test_stages_keep_columns(spark, sf):
    docs = read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "decontamination", "pii", "packing"]


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    """Nulls, repeated and missing ids, empty texts and clashing columns through all stages; and no documents at all."""
    words = " ".join(f"w{i}" for i in range(30))
    more = spark.createDataFrame([(50, words, "en", "s", 1), (50, words, "en", "s", 1), (None, words, "en", "s", 1), (50, words[::-1], "en", "s", 1), (51, "mail a.b1@x.org " + words[:60], "en", "s", 1), (52, None, None, None, None)], awkward.select("doc_id", "text", "lang", "source", "n_chars").schema)
    items = spark.createDataFrame([(0, "a b c d e f g"), (1, None), (2, "")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward.unionByName(more, allowMissingColumns=True)
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(str(tmp_path / f"out-{stage.__name__}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{stage.__name__}"))
    kept = sorted((r.doc_id, r.text.split()[0]) for r in docs.collect())
    assert [d for d, _ in kept] == [50, 50, 51] and len({t for _, t in kept}) == 3
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed) == [50, 50, 51]
    docs = empty
    for stage in (s for _, s in corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []


def test_pipeline_key(spark, awkward):
    """Without a setting a session gets a random key of its own, and keeps it."""
    spark.conf.unset(pii.SECRET)
    key = pii.configured(spark)
    assert len(key) == 64 and key != pii.DEMONSTRATION and pii.configured(spark) == key
    spark.conf.unset(pii.SECRET)
    assert pii.configured(spark) != key
    spark.conf.set(pii.SECRET, "given")
    assert pii.configured(spark) == "given"
    spark.conf.unset(pii.SECRET)
