"""The pipeline's stages: what goes, what stays, and what the last one gives back."""

import pytest

pytest.importorskip("wardline.llm")
cp = pytest.importorskip("corpus_pipeline")

from wardline.llm import jaccard, mixing, pii


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        out.append((name, before, docs))
    return {n: (a, b) for n, a, b in out}


def test_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "personal_data", "mix", "pieces"]
    for name, (_, after) in stages.items():
        assert name == "pieces" or tuple(after.columns) == cp.COLUMNS


def test_quality_keeps_clean_documents(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality"][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = jaccard.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.group_id for r in groups})
    assert not [r for r in jaccard.near_duplicates(after).collect() if r.n_links]


def test_one_row_of_each_group_stays_whatever_its_id(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (0, a + " x"), (3, b + " y"), (5, a + " z"), (None, "one two three"), (None, "one  two three"), (7, "q r s"), (7, "Q r s"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, (r.text or "").lower().split()) for r in cp.keep_one_of_each_group(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == sorted([(0, (a + " x").split()), (1, b.split()), (None, ["one", "two", "three"]), (7, ["q", "r", "s"]), (8, [])], key=str)


def test_nothing_personal_is_left(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages["personal_data"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[i].text or pii.base_spans(before[i].text)


def test_mix_takes_what_it_says(stages):
    before, after = stages["mix"]
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(before).collect()}
    words = {}
    for r in after.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len([w for w in r.text.replace("\t", " ").replace("\n", " ").split(" ") if w])
    assert words == {i: n for i, n in taken.items() if n}


def test_pieces_round_trip(stages):
    before, after = stages["pieces"]
    assert after.count() == before.count() and all(r.round_trip for r in after.collect())


def test_run_equals_stages(spark, sf, stages):
    a = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in cp.run(spark, sf).collect())
    assert a == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["pieces"][1].collect())


def test_odd_documents(spark, sf):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "word " * 50, "en", None, 250), (2, "word " * 50, "en", None, 250), (3, "call +1 (826) 555-4081 now " * 3, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        docs.count()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


@pytest.mark.parametrize("kind", [0, 1])
def test_labels_of_one_kind_reject_nothing(spark, tmp_path, kind):
    rows = [(i, f"some words number {i}", "en", "a", 20) for i in range(12)] + [(None, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, kind) for i in range(12)]
    for extra in ([], [(10**6 + i, 1 - kind) for i in range(9)]):  # then those of the other kind have no document
        path = str(tmp_path / f"{len(extra)}")
        spark.createDataFrame(labels + extra, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        kept = cp.keep_good(spark, docs, path)
        assert tuple(kept.columns) == cp.COLUMNS and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
