"""Fill-in-middle, periodic runs and URL filters against plain versions, and the cases that must not break them."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import fim, queries, runs, urls

# --- op11 -------------------------------------------------------------------------------------------------------------


def plain_cut(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < spm_below:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [None, "", " ", "a", "Z", "[]`{@", "é", "naïve 漢字\n🙂🙂 x", "has <M> inside", "<P", "S><M", "<<S<P<M", "x" * 70_000, "a b " * 20_000, "\x00\t\r\n"]


def fim_rows():
    r = random.Random(1)
    made = ["".join(r.choice("abZ <PSM>é漢🙂\n.9") for _ in range(r.randint(0, 60))) for _ in range(300)]
    return [*enumerate(ODD + made), (None, "a null id has a text"), (None, "a null id has a text"), (3, "twice"), (3, "twice")]


@pytest.mark.parametrize(("plain_from", "spm_below"), [(90, 20), (100, 100), (100, 0), (0, 20)])
def test_pieces_are_those_of_the_plain_version_and_texts_come_back(spark, plain_from, spm_below):
    rows = fim_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out, names = fim.transform(spark, df, plain_from=plain_from, spm_below=spm_below)
    got = out.withColumn("back", fim.restored(F.col(names["output"]), F.col(names["form"]))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, t or "", *plain_cut(i, t, plain_from, spm_below), t or "") for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["text"] or "", *(r[names[c]] for c in fim.ADDED), r["back"]) for r in got), key=key) == want


def test_fim_with_clashing_columns_other_sentinels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "some words. here", 5, "x", "y")], "doc_id int, text string, n int, output string, Form string")
    out, names = fim.transform(spark, df, plain_from=100, sentinels=("[p]", "[s]", "[m]"))
    row = out.withColumn("back", fim.restored(F.col(names["output"]), F.col(names["form"]), ("[p]", "[s]", "[m]"))).first()
    assert row["n"] == 5 and row["back"] == "some words. here" and row[names["output"]].startswith(("[p]", "[s]")) and out.columns[:5] == df.columns
    assert fim.transform(spark, df.where("false"))[0].count() == 0


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_token_starts(text):
    text = text.encode("utf-8", "replace").decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    assert fim.token_starts(points).tolist() == [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


# --- op12 -------------------------------------------------------------------------------------------------------------


def plain_runs(w, min_length=24, min_repeats=3):
    out = []
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            own = w[start : start + size]
            if size >= max(min_length, min_repeats * q) and all(own[p:] != own[:-p] for p in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(r):
    for _ in range(r.randint(1, 6)):
        k, n = r.choice([1, 2, 3, 5, 40]), r.randint(0, 90)
        w = [str(r.randrange(k)).encode() for _ in range(n)]
        if n and r.random() < 0.7:
            a = r.randrange(n)
            p = 1 + (n - a) // (3 + r.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if r.random() < 0.3:
            w = w * 3
        yield w


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_all_periods(seed):
    r = random.Random(seed)
    for _ in range(40):
        texts, limits = list(sequences(r)), (r.choice([1, 6, 24]), r.choice([2, 3, 4]))
        assert [[tuple(x) for x in found.tolist()] for found in runs.runs_by_text(texts, *limits)] == [plain_runs(w, *limits) for w in texts]


def test_classes_are_those_of_equal_factors_at_each_length():
    r = random.Random(7)
    for _ in range(60):
        w = [r.randrange(2) + 1 for _ in range(r.randint(1, 25))] + [0]
        part, length = runs.Partition(np.array(w)), 1
        while len(part.small):
            factors = {}
            for i in range(len(w)):
                factors.setdefault(tuple(w[i : i + length]), []).append(i)
            found = [sorted(part.order[f : f + s].tolist()) for f, s in zip(part.first[: part.classes], part.size[: part.classes], strict=True)]
            assert sorted(found) == sorted(factors.values())
            after = {a: b for f in factors.values() for a, b in zip(f, f[1:], strict=False)}
            assert part.after.tolist() == [after.get(i, -1) for i in range(len(w))]
            part.refine()
            length += 1


def test_a_long_period_and_fibonacci_words():
    r = random.Random(2)
    block = [str(r.randrange(3000)).encode() for _ in range(9000)]
    (found,) = runs.runs_by_text([[b"x"] + block * 3 + block[:5]])
    assert found.tolist() == [[1, 27005, 9000]]
    a, b = [b"a"], [b"b"]
    for _ in range(13):
        a, b = b, b + a
    assert [tuple(x) for x in runs.runs_by_text([b], 1, 2)[0].tolist()] == plain_runs(b, 1, 2)


def test_query_of_runs_equals_the_plain_version(spark, tmp_path):
    import zlib

    r = random.Random(3)
    rows = [(i, " \n".join(str(r.randrange(r.choice([1, 2, 900]))) for _ in range(r.randint(0, 400)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a " * 5000), (None, "b " * 30), (1004, "one"), (1003, "a " * 5000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(i, text):
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (i, len(found), *more, digest("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in gone)))

    got = queries.op12_periodic_runs(spark, str(tmp_path))
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(r["n_runs"] > 0 for r in got.collect()) > 10
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted((plain(i, t) for i, t in rows), key=str)


def test_runs_with_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a b " * 20, 1, 2, 3)], "text string, runs int, Collapsed int, n_words int")
    out, names = runs.with_runs(spark, df)
    row = out.first()
    assert out.columns[:4] == df.columns and (row[names["n_words"]], row[names["collapsed"]], row["runs"]) == (40, "a b", 1)
    assert [tuple(x) for x in row[names["runs"]]] == [(0, 40, 2)]
    assert runs.with_runs(spark, df.where("false"))[0].count() == 0


# --- op13 -------------------------------------------------------------------------------------------------------------

URLS = {
    "http://Www.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/"),
    "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/"),
    "x://example.com/EN/1": ("example.com", "/EN/1", "com/"),
    "http://example.com/en": ("example.com", "/en", "com/"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
    "http://example.com": ("example.com", "", None),
    "http://example.com?x=/en/": ("example.com", "", None),
    "http://com/": ("com", "/", "com/"),
    "http://a.net/es/?q#f": ("a.net", "/es/", "net/es/"),
    "http://a.net/de/#/fr/": ("a.net", "/de/", None),
    "a://b://c/d": ("b:", "//c/d", None),
    "://h/p": ("h", "/p", None),
    "http://É.net/fr/": ("É.net", "/fr/", "net/fr/"),
    "no scheme.com/en/": ("", "", None),
    "": ("", "", None),
    None: ("", "", None),
    "http://h.org/" + "s/" * 300: ("h.org", "/" + "s/" * 300, None),
}


def test_urls_are_split_and_the_longest_rule_holds(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows, names = urls.judge(spark, df, ["url"], queries.URL_RULES)
    for r in rows.collect():
        assert (r["host"], r["path"], r["rule"]) == URLS[r["url"]], r["url"]
        if r["rule"]:
            assert r["verdict"] == dict(queries.URL_RULES)[r["rule"]]
    assert rows.count() == len(URLS)


def test_templates_keep_sections_apart_and_pool_those_alike(spark):
    """Numbers are variables; sections of one shape are one branch; a bad section is blocked, a mixed or unlabelled one isn't."""
    rows = [(f"http://h.org/{s}/{i}", {"good": True, "bad": False, "like-bad": False if i % 2 else None}.get(s)) for s in ("good", "bad", "like-bad", "none") for i in range(60)]
    rows += [(f"http://g.org/{s}/{i}.html", None) for s in ("a", "b") for i in range(5)] + [("http://bad.org/x", False), ("http://bad.org/y", False), ("http://bad.org/z", None)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "url string, ok boolean").repartition(3)
    got, names = urls.judge(spark, df, ["url", "ok"], [], label=F.col("ok"))
    by = {}
    for r in got.collect():
        by.setdefault((r["host"], r["path"].split("/")[1] if r["host"] == "h.org" else ""), set()).add((r["template"], r["verdict"]))
    assert by[("h.org", "good")] == {("/=good/*", "allow")} and by[("h.org", "bad")] == {("/=bad/*", "block")}
    assert by[("h.org", "like-bad")] == {("/=like-bad/*", "block")} and by[("g.org", "")] == {("/+/*", "allow")}
    assert by[("bad.org", "")] == {("/*", "allow")}  # two bad pages: 1 of 4 with the prior's two
    assert urls.keep_allowed(spark, df, [("h.org/none/", "block"), ("h.org/", "allow")]).count() == len(rows) - 60


def test_url_filters_with_clashing_columns_deep_paths_and_no_rows(spark):
    df = spark.createDataFrame([("http://a.org/x/1", "h", 1, "v"), (None, None, None, None)] * 2, "url string, host string, _segments int, Verdict string")
    got, names = urls.judge(spark, df, df.columns, queries.URL_RULES)
    assert got.columns[:4] == df.columns and got.count() == 4 and {r[names["host"]] for r in got.collect()} == {"a.org", ""}
    assert urls.keep_allowed(spark, df, queries.URL_RULES).columns == df.columns
    assert urls.judge(spark, df.where("false"), ["url"], queries.URL_RULES)[0].count() == 0
    deep = spark.createDataFrame([("http://a.org/" + "/".join(["s"] * 40),)] * 3, "url string")
    (row,) = urls.judge(spark, deep, [], [], max_levels=3)[0].select("template").distinct().collect()
    assert row[0] == "/=s/=s/=s/**"


# --- faults of earlier operators ---------------------------------------------------------------------------------------


def test_a_broadcast_is_bounded_by_all_bytes_of_its_rows(spark, monkeypatch):
    from tessella.llm import common

    monkeypatch.setattr(common, "FEW", 10_000)
    wide = spark.createDataFrame([("x" * 6000, None, [], None)] * 2, "a string, b binary, c array<string>, d struct<e:string>")
    deep = spark.createDataFrame([(["y" * 3000] * 4, {"k": "z" * 10}, [[1, 2]])], "a array<string>, b map<string,string>, c array<array<int>>")
    few = spark.createDataFrame([(1, "short", [1.0] * 20, None)], "a int, b string, c array<double>, d struct<e:string,f:array<string>>")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert not hinted(common.small(wide)) and not hinted(common.small(deep)) and hinted(common.small(few)) and hinted(common.small(few.where("false")))


def test_quality_and_scores_with_every_name_of_theirs_taken(spark):
    from tessella.llm import classifier, quality

    good = " ".join(f"word{i}" for i in range(60))
    taken = ["host_ok", "more_ok", "host_key", "kept", "score", "n_words", "host_rate", "Base_Failed", "_key"]
    df = spark.createDataFrame([(1, good, "s", *range(9)), (2, "short", "s", *range(9))], "doc_id bigint, text string, source string, " + ", ".join(f"{c} int" for c in taken))
    kept = quality.keep_good(spark, df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
    scored = classifier.score(spark, df, classifier.fit([b"a b", b"c d"], [0, 1]))
    assert scored.columns == [*df.columns, "score_"] and all(0 <= r["score_"] <= 1 and r["score"] == 4 for r in scored.collect())


def test_a_text_over_the_cap_is_passed_over(spark):
    from tessella.llm import classifier

    rows = [(i, ("good plain words here " if i % 2 else "### *** junk $$$ ") * 20) for i in range(60)]
    first = min((i for i, _ in rows if i), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("bigint"), F.lit(1))).first()[0])
    rows = [(i, t * 500 if i == first else t) for i, t in rows]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in classifier.score(spark, docs, classifier.train(spark, docs, labels, max_bytes=60_000)).collect()}
    assert min(s for i, s in got.items() if i % 2) > 0.9 and max(s for i, s in got.items() if not i % 2) < 0.1


def test_token_files_have_stripes_row_indexes_run_lengths_and_bloom_filters(spark, tmp_path):
    """What the ORC files' own footers say."""
    from tessella.llm import token_files

    docs = spark.createDataFrame([(i, f"some words of document {i}") for i in range(300)], "doc_id bigint, text string")
    path = f"file://{tmp_path}/orc"
    token_files.write_tokens(spark, docs, path, end_id=2)
    orc, conf, seen = spark._jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration(), 0
    for f in sorted((tmp_path / "orc").rglob("*.orc")):
        reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(f)), orc.readerOptions(conf))
        rows, names = reader.rows(), list(reader.getSchema().getFieldNames())
        place = names.index("doc_id") + 1
        assert reader.getRowIndexStride() > 0 and reader.getStripes().size() >= 1
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
            assert (place, "ROW_INDEX") in kinds and any(c == place and k.startswith("BLOOM_FILTER") for c, k in kinds)
            assert str(footer.getColumnsList()[place].getKind()) == "DIRECT_V2"
            seen += stripe.getNumberOfRows()
    assert seen == 300
