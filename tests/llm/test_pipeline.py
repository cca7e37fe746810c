"""The pipeline against a plain version of its decisions, on the smallest tables."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "segmentation":
            assert docs.columns == columns
    known = sorted(r["doc_id"] for r in seen["language_id"])
    assert len(known) > 0.98 * len(texts)
    sets = {i: shingles(texts[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for i in known}
    label = {i: i for i in known}
    for _ in range(3):
        for i in known:
            for j in known:
                if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    kept = {i for i in known if label[i] == i}
    assert {r["doc_id"] for r in seen["near_duplicates"]} == kept
    items = [shingles(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i in kept if any(s <= shingles(texts[i].lower()) for s in items)}
    touched = {i for i in kept if any(s & shingles(texts[i].lower()) for s in items)}
    clean = {r["doc_id"] for r in seen["decontamination"]}
    assert kept - touched <= clean <= kept - whole
    assert {r["doc_id"] for r in seen["secrets"]} == clean
    for r in seen["secrets"]:
        assert r["n_chars"] == len(r["text"]) and not re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r["text"])
        assert r["text"] == texts[r["doc_id"]] or "[secret]" in r["text"]
    assert {r["doc_id"] for r in seen["segmentation"]} == clean and all(r["decoded"] for r in seen["segmentation"])


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(*r, "mine", 7, [1], True, "x") for r in docs]
    rows += [rows[3], (5_000_000_000, None, "en", None, 11, "mine", 7, [1], True, "x"), (5_000_000_001, "", None, "s", None, "mine", 7, None, False, "x"), (None, rows[0][1], "en", "s", 5, "mine", 7, [1], True, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, leaks array<int>, rejected boolean, base_spans string")


def test_extra_columns_stay_as_they_are(spark, odd):
    before = {(r["doc_id"], r["source"]): r for r in odd.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        rows = out.collect()
        assert rows
        for r in rows:
            was = before[r["doc_id"], r["source"]]
            keep = [c for c in odd.columns if name != "secrets" or c not in ("text", "n_chars")]
            assert [r[c] for c in keep] == [was[c] for c in keep], name
            if r["text"] is None:
                assert r["n_chars"] == was["n_chars"]


def test_nulls_and_repeated_rows_pass(spark, odd):
    known = pipeline.identify_language(spark, odd, SF)
    assert not known.where("text is null or text = ''").count()
    assert pipeline.redact_secrets(spark, odd, SF).count() == odd.count()
    clean = pipeline.decontaminate(spark, odd, SF)
    assert clean.where("text is null or text = ''").count() == 2
    last = pipeline.segment(spark, odd, SF)
    assert last.count() > 0


def test_empty_table_passes_every_stage(spark, odd):
    docs = odd.where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert not out.count(), name
