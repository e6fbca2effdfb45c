"""The stored index against search over texts: the same hits, few blocks opened, changed documents written alone, runs that fail leave no trace."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import gate as E
from tessella.operators import retrieval as R
from tessella.sources import inverted


def corpus(n=300, seed=3):
    """Texts of skewed words and lengths; every document has one to three records."""
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    return [(f"d{i}", f"d{i}-{j}", " ".join(r.choice(words) for _ in range(int(r.paretovariate(0.8)) % 400 + 3))) for i in range(n) for j in range(1 + i % 3)]


def records(spark, rows):
    return R.records(spark.createDataFrame(rows, "doc_id string, id string, text string").repartition(3))


def queries(spark, rows, seed=4):
    r = random.Random(seed)
    asked = [(i, r.choice(rows)[2].split()[: r.choice([1, 3, 12])] * r.choice([1, 2])) for i in range(25)] + [(90, ["absent"]), (91, [])]
    return spark.createDataFrame(asked, "query_id int, tokens array<string>")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


def same_as_texts(spark, root, rows, k=5):
    index, recs, asked = inverted.open_index(spark, root), records(spark, rows), queries(spark, rows)
    assert hits(index.search(asked, k)) == hits(R.bm25(asked, recs, k))
    want = {(r["term"], r["df"], round(r["idf"], 9)) for r in R.term_weights(R.document_frequencies(recs), R.corpus_stats(recs)).collect()}
    assert {(r["term"], r["df"], round(r["idf"], 9)) for r in index.term_weights().collect()} == want
    assert sorted(r["id"] for r in index.records().collect()) == sorted(r[1] for r in rows)


def files(root, table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(os.path.join(root.removeprefix("file://"), table)) for f in names if f.endswith(".parquet")}


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(inverted, "RANGE_RECORDS", 8)


def test_hits_are_those_of_the_texts_and_stay_so_through_updates(spark, tmp_path, small_ranges):
    root, rows = f"file://{tmp_path}/index", corpus()
    vectors = lambda recs: R.hash_embeddings(recs.select("id", "text"), dim=8).select("id", "v")
    assert inverted.update_index(records(spark, rows), root, {"dim": 8}, vectors) == "built"
    same_as_texts(spark, root, rows)
    assert inverted.update_index(records(spark, rows), root, {"dim": 8}, vectors) == "skipped"
    before = {t: files(root, t) for t in ("records", "postings", "vectors", "manifest", "terms")}

    # one text changes, one document goes, one comes
    changed = [(d, i, f"entirely new words {d}" if i == "d7-0" else t) for d, i, t in rows if d != "d11"] + [("fresh", "fresh-0", "another new text with words")]
    assert inverted.update_index(records(spark, changed), root, {"dim": 8}, vectors) == "updated"
    same_as_texts(spark, root, changed)
    for t, was in before.items():
        now = files(root, t)
        assert {f: now[f] for f in was} == was and all("run=1" in f for f in set(now) - set(was))
    index = inverted.open_index(spark, root)
    written = spark.read.parquet(f"{root}/records/run=1").select("doc_id").distinct().collect()
    assert {r[0] for r in written} == {"d7", "fresh"}
    assert sorted(r["id"] for r in index.vectors().collect()) == sorted(i for _, i, _ in changed)
    assert {r["doc_id"] for r in index.documents().collect()} == {d for d, _, _ in changed}

    # it goes back to what it was: a document that went returns; an update of some documents takes none away
    assert inverted.update_index(records(spark, rows), root, {"dim": 8}, vectors) == "updated"
    same_as_texts(spark, root, rows)
    some = [("d3", "d3-0", "some documents alone are updated")]
    assert inverted.update_index(records(spark, some), root, {"dim": 8}, vectors, whole=False) == "updated"
    same_as_texts(spark, root, [r for r in rows if r[0] != "d3"] + some)
    assert inverted.update_index(records(spark, some[:0]), root, {"dim": 8}, vectors, whole=False) == "skipped"

    # settings, or more that is stale than not, write everything anew
    assert inverted.update_index(records(spark, rows), root, {"dim": 9}, vectors) == "built"
    assert len(inverted.commits(spark, root)) == 1
    other = [(d, i, f"{t} more") for d, i, t in rows[: len(rows) * 2 // 3]]
    assert inverted.update_index(records(spark, other), root, {"dim": 9}, vectors) == "built"
    same_as_texts(spark, root, other)


def test_a_run_without_commit_does_not_exist(spark, tmp_path, small_ranges):
    root, rows = f"file://{tmp_path}/index", corpus(40)
    inverted.update_index(records(spark, rows), root)

    def fails(recs):
        raise RuntimeError("an executor's machine went")

    changed = [(d, i, t + " changed") if d == "d1" else (d, i, t) for d, i, t in rows]
    with pytest.raises(RuntimeError):
        inverted.update_index(records(spark, changed), root, vectors=fails)
    same_as_texts(spark, root, rows)
    assert inverted.update_index(records(spark, changed), root) == "updated"
    same_as_texts(spark, root, changed)
    with pytest.raises(Exception, match="exists"):
        inverted.commit(spark, root, inverted.commits(spark, root)[-1])


def test_blocks_that_cannot_reach_the_first_hits_stay_closed(spark, tmp_path, small_ranges, monkeypatch):
    root, rows = f"file://{tmp_path}/index", corpus(600, 9)
    inverted.update_index(records(spark, rows), root)
    index, opened = inverted.open_index(spark, root), []
    real = inverted.Index.postings
    monkeypatch.setattr(inverted.Index, "postings", lambda self, of: (opened.append(of.count()), real(self, of))[1])
    asked = spark.createDataFrame([(i, rows[i][2].split()[:12]) for i in (3, 30, 77)], "query_id int, tokens array<string>")
    index.search(asked, 3).collect()
    everything = index.table("postings").join(index.asked(asked, 0.25), ["part", "term"]).count()
    assert opened[1] < 0.6 * everything


def test_a_search_reads_the_folders_of_its_terms_and_no_text(spark, tmp_path, small_ranges, capsys):
    root, rows = f"file://{tmp_path}/index", corpus(60)
    inverted.update_index(records(spark, rows), root)
    index = inverted.open_index(spark, root)
    found = index.search(spark.createDataFrame([(1, ["w1"])], "query_id int, tokens array<string>"), 3)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "records" not in plan and "text" not in plan
    named = index.named(index.table("postings"), spark.createDataFrame([("w1",)], "term string"))
    assert len({f for f in named.select("_metadata.file_path").distinct().toPandas()["file_path"]}) == 1


def test_negative_weights_repeated_ids_and_empty_corpora(spark, tmp_path, small_ranges):
    root = f"file://{tmp_path}/index"
    rows = [(f"d{i}", f"d{i}", "common words here" + (" rare" if i == 0 else "")) for i in range(4)]  # every idf but one is negative, and so their mean
    inverted.update_index(records(spark, rows), root)
    same_as_texts(spark, root, rows, 2)
    with pytest.raises(ValueError, match="repeats"):
        inverted.update_index(records(spark, rows + rows[:1]), f"{root}2")
    with pytest.raises(ValueError, match="long enough"):
        inverted.update_index(records(spark, rows[:0]), f"{root}3")
    with pytest.raises(FileNotFoundError):
        inverted.open_index(spark, f"{root}3")
    with pytest.raises(ValueError, match="embedder"):
        inverted.open_index(spark, root, embedder="other")
    # everything goes, and some comes back
    assert inverted.update_index(records(spark, rows[:0]), root) == "updated"
    assert hits(inverted.open_index(spark, root).search(queries(spark, rows), 3)) == []
    assert inverted.update_index(records(spark, rows[:2]), root, whole=False) == "built"  # more is stale than not
    same_as_texts(spark, root, rows[:2], 2)
    assert inverted.update_index(records(spark, rows[1:3]), root, force=True, whole=False) == "built"
    same_as_texts(spark, root, rows[:3], 2)


def test_gate_by_postings_is_that_by_tokens(spark, tmp_path, small_ranges):
    root, rows = f"file://{tmp_path}/index", corpus(80)
    inverted.update_index(records(spark, rows), root)
    index, asked, recs = inverted.open_index(spark, root), queries(spark, rows), records(spark, rows)
    found = index.search(asked, 8).withColumnRenamed("score", "sparse_score")
    want = E.evaluate(asked, found.join(recs.select("id", "tokens"), "id"))
    got = E.evaluate(asked, found, found=index.holds(E.wanted_tokens(asked), found))
    key = lambda df: sorted((r["query_id"], r["n_covered"], r["focus"], r["coverage_score"], tuple(r["missing"])) for r in df.collect())
    assert key(got) == key(want)
