"""The training-data operators against plain versions, and the cases that must not break them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import ann, classifier, common, components, lines, minhash, mixing, packing, pii, quality, substring, token_files, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GAPS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def vocabulary(seed=1, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(n)]


def corpus(n=60, seed=2):
    """Documents with exact and near copies, shared lines and passages, personal data, nulls, empty texts, repeated rows and ties."""
    r, v = random.Random(seed), vocabulary()
    passage = " ".join(r.choice(v) for _ in range(60))
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(v) for _ in range(r.randint(4, 40))) for _ in range(r.randint(1, 6)))
        if i % 7 == 0:
            text += "\nAll rights reserved by the same people here"
        if i % 9 == 0:
            text = " ".join(r.choice(v) for _ in range(15)) + " " + passage + " " + " ".join(r.choice(v) for _ in range(30))
        if i % 11 == 3 and rows:
            w = rows[-1][1].split(" ") if rows[-1][1] else ["x"]
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        if i % 13 == 4 and rows:
            text = rows[0][1].upper()
        if i % 10 == 6:
            text += f"\nmail jo{i % 3}@ex-ample.co.uk or +44 (0)20 7946 0{i:03d}, 10.0.{i}.255 card 4111-1111 1111 1111"
        rows.append([i * 3, text, "en", f"src{i % 4}" if i % 5 else None, len(text)])
    rows += [[1000, None, None, None, None], [1001, "", "en", "src1", 0], [1002, " \t\n", "en", "", 3], [1003, "one", "en", "src1", 3], [1004, "ONE", "en", "src1", 3], [1005, "two words", "en", "src1", 9]]
    rows += [rows[5], rows[5]]
    rows.append([2000, ("Very long Text " * 4000) + "end", "en", "src0", 60003])
    rows.append([2001, "x" * 50_000 + " a@b.cc " + "1" * 3000, "en", "src0", 53008])
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- plain versions ---------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_classes(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), r[0] if not sets[i] else least[root(i)]) for i, r in enumerate(rows))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def good(kind, m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def plain_stats(text):
    w = words(text)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(3)}
    ls = [x for x in (text or "").split("\n") if x.strip(GAPS)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(hit)


# --- op1 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_classes_are_those_of_all_pairs(spark, docs, k, percent):
    got = minhash.grouped(spark, docs, k=k, percent=percent).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == near_classes(corpus(), k, percent)


def test_near_copies_around_a_threshold_chain_into_one_group(spark):
    """Copies of copies, so that first and last are unlike, and many copies of one text that differ from each other."""
    r, v = random.Random(4), vocabulary(5)
    base = [r.choice(v) for _ in range(120)]
    rows, w = [], list(base)
    for i in range(30):
        w[(i * 4) % 120] = f"step{i}"
        rows.append((i, " ".join(w)))
    for i in range(40):
        x = list(base)
        for j in r.sample(range(120), 3):
            x[j] = f"own{i}{j}"
        rows.append((100 + i, " ".join(x)))
    got = minhash.grouped(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x["id"], x["n_shingles"], x["component_id"]) for x in got) == near_classes(rows, 3, 85)


def test_one_document_of_each_group_stays(spark, docs):
    kept = minhash.drop_near_duplicates(spark, docs, k=3, percent=85)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    expected = near_classes(corpus(), 3, 85)
    blank = [1000, 1001, 1002]
    assert ids == sorted([*{c for i, n, c in expected if n}, *blank])


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d", "x", 1), (None, "a b c d", "y", 2), (7, "a b c d", "z", 3), (None, "lone words stand here", "q", 4), (None, None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, component_id int").withColumnsRenamed({}).withColumn("kept", F.lit(True)).withColumn("_gone_id", F.lit(1))
    got = Counter((r["id"], r["component_id"]) for r in minhash.grouped(spark, df).collect())
    assert got == Counter({(None, 7): 2, (7, 7): 1, (None, None): 2})
    kept = minhash.drop_near_duplicates(spark, df)
    assert kept.columns == df.columns
    assert Counter(r["component_id"] for r in kept.collect()) == Counter([3, 4, 5])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [a, np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)]), np.empty(0, np.uint64), a[:1]]
    s = minhash.super_minhash(sets, 125)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.13
    assert np.isinf(s[2]).all() and np.isfinite(s[[0, 1, 3]]).all()
    assert sorted(np.floor(s[3]).astype(int)) == list(range(125))  # one element visits each register once


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=50, deadline=None)
def test_forest_joins_what_links_join(links):
    links = [(a, b) for a, b in links if a != b]
    root = dict(components.forest(links))
    for a, b in links:
        assert root.get(a, a) == root.get(b, b) <= min(a, b)


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    links = chain + star + [(5000, 4000)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    got = {x["node"]: x["root"] for x in components.connected_components(df, common.Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}, 5000: 4000}


# --- op2 --------------------------------------------------------------------------------------------------------------


def test_passages_inside_of_lines_are_found_and_others_left(spark, docs):
    rows = substring.repeats(spark, docs).collect()
    holders = {r[0] for i, r in enumerate(corpus()[:60]) if i % 9 == 0 and "changed" not in r[1]}
    clusters = defaultdict(set)
    for r in rows:
        clusters[r["cluster"]].add(r["doc_id"])
    assert any(holders <= c for c in clusters.values())
    by = defaultdict(Counter)
    for i, t, *_ in {(r[0], r[1]) for r in corpus()}:
        by[i] = Counter(words((t or "").lower()))
    for r in rows:  # a repeated piece stands word by word in the first document too
        if r["kind"] == 1:
            w = words(next(t for i, t, *_ in corpus() if i == r["doc_id"]).lower())[r["start"] : r["start"] + r["n_words"]]
            assert not Counter(w) - by[r["first_doc_id"]]


def test_passages_in_short_lines_are_found_however_they_are_wrapped(spark):
    r, v = random.Random(12), vocabulary(13)
    passage = [r.choice(v) for _ in range(120)]

    def wrapped(n):
        return "\n".join(" ".join(passage[i : i + n]) for i in range(0, len(passage), n))

    own = [" ".join(r.choice(v) for _ in range(30)) for _ in range(4)]
    rows = [(1, own[0] + "\n" + wrapped(8)), (2, own[1] + "\n" + wrapped(11)), (3, own[2] + "\n" + wrapped(3)), (4, own[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = defaultdict(set)
    for x in substring.repeats(spark, df).collect():
        found[x["doc_id"]] |= set(range(x["start"], x["start"] + x["n_words"]))
    assert set(found) == {1, 2, 3} and all(len(f) >= 80 and min(f) >= 30 for f in found.values())
    out = {x["doc_id"]: words(x["text"]) for x in substring.drop_repeats(spark, df).collect()}
    assert len(out[1]) == 150 and len(out[2]) <= 70 and len(out[3]) <= 70 and len(out[4]) == 30


def test_like_lines_are_linked_by_exact_jaccard(spark):
    r, v = random.Random(8), vocabulary(9)
    line = [r.choice(v) for _ in range(60)]
    other = list(line)
    other[30] = "edited"
    rows = [(1, "first line here\n" + " ".join(line)), (2, " ".join(other)), (3, " ".join(r.choice(v) for _ in range(60))), (4, None)]
    got = [x for x in substring.repeats(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if x["kind"] == 0]
    assert {(x["doc_id"], x["first_doc_id"], x["kept"], x["start"]) for x in got} == {(1, 1, True, 3), (2, 1, False, 0)}


def test_repeats_are_cut_from_later_documents(spark, docs):
    out = {(r["doc_id"]): r["text"] for r in substring.drop_repeats(spark, docs).collect()}
    first = corpus()[0]
    assert out[0] == first[1] and out[1000] is None and len(words(out[27])) < len(words(corpus()[9][1]))


# --- op3, op7 ---------------------------------------------------------------------------------------------------------


def plain_ids(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_encode_as_the_whole_text_does(text):
    text = text.replace("\ud800", "")
    for t in (text, f" {text},  {text.upper()}.\u00e9 x!?", f"{text}<|endoftext|>"):
        ((ids, ends),) = tokens.encoder(tokens.default_tokenizer()).encode(pa.array([t.encode(), None], pa.binary()), 7)
        assert ids[: ends[0]].tolist() == plain_ids(t, 7) and ids[ends[0] :].tolist() == [7]


def test_packing_holds_every_piece_once(spark, docs):
    got = packing.pack(spark, docs, length=64).collect()
    expected = Counter()
    for r in corpus():
        ids = plain_ids(r[1], 0)
        for k in range(0, len(ids), 64):
            part = np.asarray(ids[k : k + 64], "<u4").tobytes()
            expected[(r[0], k // 64, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 64) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plans_hold_all_capacities(rule):
    r = random.Random(6)
    counts = {s: r.randint(1, 300) for s in range(1, 101)}
    cap = (100, 6, 4000)
    counts = {s: c for s, c in counts.items() if s * s <= cap[2]}
    p = packing.plan(counts, cap, (1.0, 0.3, 0.5), rule)
    used = defaultdict(lambda: [0, 0, 0])
    placed = Counter()
    for size, first, count, per, seq, offset in sorted(zip(p.length, p.first, p.count, p.per, p.sequence, p.offset, strict=True), key=lambda e: e[5]):
        placed[size] += count
        for i in range(count):
            u = used[seq + i // per]
            assert u[0] == offset + i % per * size
            u[0] += size
            u[1] += 1
            u[2] += size * size
    assert placed == Counter(counts) and all(u[0] <= 100 and u[1] <= 6 and u[2] <= 4000 for u in used.values()) and len(used) == p.sequences


def test_token_files_read_back(spark, docs):
    path = common.Scratch(spark, "t").where("orc")
    token_files.write_tokens(spark, docs, path, end_id=2)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_index(spark, path).collect())
    start, expected = 0, []
    for r in sorted(corpus(), key=lambda r: r[0]):
        ids = np.asarray(plain_ids(r[1], 2), "<u4").tobytes()
        expected.append((r[0], start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == sorted(expected)
    one = token_files.read_tokens(spark, path).where("doc_id = 1003")
    assert [r["ids"] for r in one.collect()] == [plain_ids("one", 2)]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1003)]" in one._jdf.queryExecution().toString()


# --- op4, op5, op9 ----------------------------------------------------------------------------------------------------


def test_quality_counts_and_verdicts(spark, docs):
    rows, _ = quality.judge(spark, docs, ["doc_id", "source"])
    got = rows.collect()
    plain = Counter((r[0], *plain_stats(r[1])) for r in corpus())
    assert Counter((r["doc_id"], *(r[k] for k in quality.STATS)) for r in got) == plain
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= 0.5)


def test_a_bad_host_is_rejected_and_a_small_one_is_not_for_one_failure(spark):
    rows = [("bad", True)] * 95 + [("bad", False)] * 5 + [("small", True)] + [(f"h{i}", j == 0) for i in range(20) for j in range(30)]
    v = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, failed boolean"), "source", "failed").collect()}
    assert not v["bad"]["host_ok"] and v["small"]["host_ok"] and v["h3"]["host_ok"]


def test_all_quality_rules_decide_what_is_kept(spark):
    r, v = random.Random(3), vocabulary()
    plain = [" ".join(r.choice(v) for _ in range(60)) for _ in range(52)]
    rows = [(i, t, "good") for i, t in enumerate(plain[:40])]
    rows += [(100, plain[0] + " #" * 7, "good"), (101, plain[1] + " #" * 6, "good"), (103, " ".join(f"{a}{a}{a}{a}" for a in plain[2].split()), "good")]
    rows += [(102, "\n".join([plain[40]] + [f"a{i}" for i in range(3)] + ["one two"] * 9), "good"), (104, " ".join(f"{chr(97 + i % 26)}{i % 7}" for i in range(60)), "good")]
    rows += [(200 + i, t + " $" * (9 if i else 0), "bad") for i, t in enumerate(plain[41:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {x["doc_id"]: x for x in quality.judge(spark, df, ["doc_id"])[0].collect()}
    assert not any(x["base_failed"] for i, x in got.items() if i != 104)
    assert {i for i, x in got.items() if x["symbols_failed"]} == {100, *range(201, 211)}
    assert {i for i, x in got.items() if x["lines_failed"]} == {102} and {103, 104} == {i for i, x in got.items() if x["length_failed"]}
    # 200 fails no rule, and its host does
    assert {i for i, x in got.items() if x["kept"]} == {*range(40), 101} == {x["doc_id"] for x in quality.keep_good(spark, df).collect()}


def test_quality_keeps_the_columns(spark, docs):
    odd = docs.withColumn("n_words", F.lit("mine")).withColumn("KEPT", F.lit(1)).withColumn("host_rate", F.lit(2))
    out = quality.keep_good(spark, odd)
    assert out.columns == odd.columns and out.count() == docs.join(quality.judge(spark, docs, ["doc_id"])[0].where("kept").select("doc_id").distinct(), "doc_id").count()


def plain_mix(rows, passes=2):
    sizes = [len(words(r[1])) for r in rows]
    total = Counter()
    for r, n in zip(rows, sizes, strict=True):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > passes * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: passes * total[s] for s in over}
        left -= sum(passes * total[s] for s in over)
        free -= over
    return sizes, total, target


def test_mix_takes_the_targets(spark, docs):
    names = {k: k for k in ("size", "source_size", "target", "taken")}
    got = mixing.mix(spark, docs, names).collect()
    sizes, total, target = plain_mix(corpus())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], n) for r, n in zip(corpus(), sizes, strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix(spark, docs.repartition(5), names).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def queued(rows, passes=2):
    """(finish, words, row) of each document and pass, by the words before it in its source's shuffle."""
    sizes, total, target = plain_mix(rows, passes)
    out, at = [], Counter()
    for i in sorted(range(len(rows)), key=lambda i: hashlib.md5(f"17:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()):
        s = rows[i][3]
        goal = math.floor(target[s] + 0.5)
        out += [((at[s] + turn * total[s] + sizes[i]) / goal, sizes[i], i) for turn in range(passes) if goal and sizes[i]]
        at[s] += sizes[i]
    return sorted(out), sum(math.floor(t + 0.5) for t in target.values())


def test_mixed_documents_are_those_that_finish_within_the_budget(spark, docs):
    out = mixing.mixed_documents(spark, docs)
    assert out.columns == docs.columns
    queue, budget = queued(corpus())
    cut = max((f for f, _, _ in queue if sum(n for g, n, _ in queue if g <= f) <= budget), default=0)
    want = Counter((corpus()[i][0], corpus()[i][1]) for f, _, i in queue if f <= cut)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert budget - 60_000 < sum(len(words(t)) * n for (_, t), n in want.items()) <= budget


def test_virtual_finish_times(spark, docs):
    got = mixing.mix(spark, docs, {"finish": "finish", "taken": "taken"}).collect()
    first = defaultdict(list)
    for f, n, i in queued(corpus(), 1)[0]:
        first[corpus()[i][0]].append(f)
    sizes, total, target = plain_mix(corpus())
    for r in got:
        if r["doc_id"] in first:
            goal = math.floor(target[r["source"]] + 0.5)
            # the targets are those of two passes
            assert any(r["finish"] * goal == pytest.approx(f * math.floor(plain_mix(corpus(), 1)[2][r["source"]] + 0.5)) for f in first[r["doc_id"]])
    assert all(r["taken"] > 0 for r in got if r["finish"] is not None and r["finish"] <= 1 and len(words(r["text"])))


def test_sums_in_a_global_order(spark):
    rows = [(i * 7 % 50, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(5)
    got = common.ranged(common.Scratch(spark, "t"), df, [F.col("k")], {"upto": F.col("n")}, "r", peers=True).collect()
    assert len(got) == 200 and all(r["upto"] == sum(n for k, n in rows if k <= r["k"]) for r in got)
    got = sorted((r["k"], r["before"]) for r in common.ranged(common.Scratch(spark, "t"), df.select("k").distinct(), [F.col("k")], {"before": F.col("k")}, "r").collect())
    assert got == [(k, sum(range(k))) for k in range(50)]


def plain_lines(rows, min_docs=3):
    holders = defaultdict(set)

    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(GAPS))

    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(key(x)) >= 20 and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != i)]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


def test_shared_lines_stay_once(spark, docs):
    odd = docs.withColumn("_drop", F.lit(1)).withColumn("_ID", F.lit(2))
    out = lines.drop_shared_lines(spark, odd, counts=("n_lines", "n_dropped"))
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect())
    assert got == plain_lines(corpus())


# --- op6 --------------------------------------------------------------------------------------------------------------


def test_nearest_reach_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[100:400] = x[100]  # one common vector
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [None] * 24), (9200, [1.0, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("key", F.lit("a"))
    got = defaultdict(list)
    for r in ann.search(spark, df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits, common_queries = 0, 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [g[0] for g in got[q]] == [1, 2, 3, 4, 5]
        hits += len(set(best) & {g[1] for g in got[q]})
        if 100 <= q < 400:
            common_queries += 1
            assert [g[1] for g in got[q]] == best
        for _, i, score in got[q]:
            assert score == pytest.approx(float(u[i] @ u[q]), abs=1e-9)
    assert hits / 300 >= 0.9 and common_queries and len(got) == 60


def test_nearest_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4500, 32))
    x[:2000] = x[0] + 0.01 * rng.standard_normal((2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(spark, df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(len(got[q] & set(np.argsort(-(u @ u[q]))[1:6].tolist())) for q in range(0, 2000, 100))
    assert hits >= 0.99 * 5 * 20


def test_nearest_of_very_long_and_very_short_vectors(spark):
    rows = [(0, [1.0, 0.9]), (1, [2.0**900, 2.0**900]), (2, [1e-200, -1e-200]), (3, [1.0, 1.0]), (4, [-3.0, 0.5]), (5, [5e-324, 0.0]), (6, [2.0**-900, 2.0**-900])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["id"], r["score"]) for r in ann.search(spark, df, F.col("vec_id") == 0, k=6).orderBy("rank").collect()]
    from fractions import Fraction

    def cosine(x, y):
        x, y = ([Fraction(c) / max(map(abs, map(Fraction, v))) for c in v] for v in (x, y))
        return float(sum(a * b for a, b in zip(x, y, strict=True))) / (float(sum(a * a for a in x)) ** 0.5 * float(sum(b * b for b in y)) ** 0.5)

    want = sorted(((-cosine(rows[0][1], v), i) for i, v in rows[1:]))
    assert [g[0] for g in got[:3]] == [1, 3, 6] and sorted(g[0] for g in got) == [1, 2, 3, 4, 5, 6]
    assert [g[1] for g in got] == pytest.approx([-s for s, _ in want])


def test_each_dimension_is_searched_by_itself(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(i, [float(i), 1.0, 2.0]) for i in range(6, 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(spark, df, F.col("vec_id") >= 0).collect():
        got[r["query_id"]].add(r["id"])
    assert all(got[i] == set(range(6)) - {i} for i in range(6)) and all(got[i] == {6, 7, 8} - {i} for i in range(6, 9))


def test_few_vectors_give_all(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(spark, df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 1.0), (0, 2, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 0.0)]


# --- op8 --------------------------------------------------------------------------------------------------------------


def test_classifier_learns_and_leaves_the_fold_out(spark):
    r, v = random.Random(5), vocabulary()
    rows = []
    for i in range(400):
        good = i % 3 > 0
        w = [r.choice(v) for _ in range(60)] if good else [x for _ in range(10) for x in [r.choice(v)] * 6]
        rows.append((i, " ".join(w), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows] + [(None, 1), (900, None)], "doc_id bigint, quality int")
    got = {x["doc_id"]: x["score"] for x in classifier.score(spark, docs, classifier.train(spark, docs, labels)).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.9
    assert got[900] == got[901] and 0 <= got[900] <= 1


# --- op10 -------------------------------------------------------------------------------------------------------------

ALPHABET = "a1Z@@..+--(0) 9\n٣_é%"


@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=30, max_size=60))
@settings(max_examples=6, deadline=None)
def test_base_spans_are_those_of_the_patterns(spark, texts):
    hard = ["a@b.c_d@e.f g@h.i@j.k", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (2) 345-678-90)", "x@y.z-" * 50, "1" * 400, "+1" * 50]
    texts = [*texts, *hard]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    names = F.array(*map(F.lit, (*pii.KINDS, "term")))
    got = {r["i"]: r["s"] for r in df.select("i", pii.joined(pii.base_spans(F.col("text")), names).alias("s")).collect()}
    assert got == {i: ",".join(plain_pii(t)) for i, t in enumerate(texts)}


def test_pii_over_the_corpus_and_a_revealing_term(spark, docs):
    rows = [(5000 + i, f"line one\nplease write to Quibbleton via vex@hidden.org today {i}", "en", "s", 0) for i in range(9)]
    got = pii.find(spark, docs.union(spark.createDataFrame(rows, SCHEMA))).collect()
    names = [*pii.KINDS, "term"]
    plain = {r[0]: plain_pii(r[1]) for r in [*corpus(), *rows]}
    for r in got:
        assert [f"{names[s['kind']]}:{s['start']}:{s['stop']}" for s in r["base"]] == plain[r["id"]]
    for r in got:
        if r["id"] >= 5000:
            assert "quibbleton" in {s["value"] for s in r["more"]}
    cut = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs.union(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert "[email]" in cut[5000] and "Quibbleton" not in cut[5000] and cut[0] == corpus()[0][1] and cut[1000] is None


def plain_told(texts, threshold=0.9, error=0.05):
    """(entity, term) by the definition: mutual information and Chernoff's bound over different texts, for all pairs."""
    import regex

    names, held, words_ = [*pii.KINDS], defaultdict(set), defaultdict(set)
    different = sorted({t or "" for t in texts})
    for i, t in enumerate(different):
        for span in plain_pii(t):
            kind, lo, hi = span.split(":")
            v = t[int(lo) : int(hi)]
            held[f"{names.index(kind)}:{v.lower() if kind == 'email' else v if kind == 'ip' else re.sub('[^0-9]', '', v)}"].add(i)
        for w in regex.findall(r"[\p{L}\p{N}\p{M}]+(?:['’_-]+[\p{L}\p{N}\p{M}]+)*", t):
            words_[w.lower()].add(i)
    n, bits, out = len(different), math.log2(max(1, len(held)) * max(1, len(words_)) / error), set()
    for e, at in held.items():
        q = len(at) / n
        for w, of in words_.items():
            both, p = len(at & of), len(at & of) / len(of)
            if not both or q == 1 or math.log2(n * both / (len(at) * len(of))) < threshold * -math.log2(q) - 1e-9:
                continue
            gain = len(of) * (p * math.log2(p / q) + ((1 - p) * math.log2((1 - p) / (1 - q)) if p < 1 else 0))
            if gain >= bits - 1e-9:
                out.add((e, w))
    return out


def planted_people(n=40, seed=6):
    """Texts with people's values, names in texts with the value and without, words of all texts, copies, ties, and signs inside of names."""
    r, v = random.Random(seed), vocabulary()
    names = [f"{r.choice(['mc', 'Van', 'del'])}{w}{i}" + ("'brannig" if i % 3 == 0 else "-ley" if i % 3 == 1 else "") for i, w in enumerate(r.sample(v, n))]
    texts = [" ".join(r.choice(v) for _ in range(30)) + f" {i}" for i in range(300)]
    for i, name in enumerate(names):
        value = (f"p{i}@hidden.org", f"10.0.0.{i}", f"+44 20 7946 {1000 + i}")[i % 3]
        texts += [f"{r.choice(v)} {j} name:{name}/{r.choice(v)}\n{' '.join(r.choice(v) for _ in range(60))} {value} and {i}_{j}" for j in range(r.choice([1, 3, 5, 8]))]
        texts += [f"{name.upper()} stands alone {r.choice(v)} {j}" for j in range(i % 3)]
    return names, texts + texts[300:340] * 5 + [None, "", texts[-1]]


def test_pii_terms_are_those_of_the_definition_and_found_wherever_they_stand(spark):
    names, texts = planted_people()
    told = {w for _, w in plain_told(texts)}
    # names of people whose value stands in a few texts or more, the values' own parts, and nothing else
    assert len(told & {n.lower() for n in names}) >= 15 and not told & set(vocabulary())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pii.find(spark, df).collect()
    assert set().union(*({s["value"] for s in r["more"]} for r in got)) <= told
    away = 0
    for r in got:
        t = texts[r["id"]] or ""
        free = [s for s in r["more"] if not any(b["start"] < s["stop"] and s["start"] < b["stop"] for b in r["base"])]
        assert free == r["more"] and all(t[s["start"] : s["stop"]].lower() == s["value"] for s in free)
        for w in told & {n.lower() for n in names}:
            assert t.lower().count(w) == sum(s["value"] == w for s in free), (w, t)
        away += bool(free) and not r["base"]
    assert away >= 10  # a term reveals its value where that isn't written


def test_pii_terms_need_evidence(spark):
    one = ["Quibbleton vex@hidden.org"] + [f"{i} is another text of few words" for i in range(200)]
    assert not plain_told(one)
    assert not any(r["more"] for r in pii.find(spark, spark.createDataFrame(list(enumerate(one)), "doc_id bigint, text string")).collect())


def test_places_of_many_matches(spark):
    text = " ".join(f"{i}" for i in range(5000))
    got = spark.createDataFrame([(text,)], "t string").select(pii.matches(F.col("t"), "[0-9]+", 2).alias("m")).first()["m"]
    assert [(s["start"], s["stop"]) for s in got] == [m.span() for m in re.finditer("[0-9]+", text)]


# --- empty tables -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("run", [
    lambda s, e: minhash.grouped(s, e), lambda s, e: minhash.drop_near_duplicates(s, e), lambda s, e: substring.repeats(s, e), lambda s, e: packing.pack(s, e),
    lambda s, e: quality.keep_good(s, e), lambda s, e: mixing.mixed_documents(s, e), lambda s, e: lines.drop_shared_lines(s, e), lambda s, e: pii.find(s, e), lambda s, e: pii.sanitise(s, e),
    lambda s, e: classifier.score(s, e, classifier.train(s, e, e.selectExpr("doc_id", "1 as quality"))),
    lambda s, e: ann.search(s, e.selectExpr("doc_id as vec_id", "array(1.0) as embedding"), F.col("vec_id") == 0),
])
def test_empty_tables_give_empty_tables(spark, empty, run):
    assert run(spark, empty).count() == 0


def test_empty_token_files(spark, empty):
    path = common.Scratch(spark, "t").where("orc")
    token_files.write_tokens(spark, empty, path)
    assert token_files.token_index(spark, path).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, docs):
    import corpus_pipeline

    odd = docs.withColumn("size", F.lit("x")).withColumn("comp", F.lit("y"))
    stages = dict(corpus_pipeline.STAGES)
    rows = odd
    scratch = common.Scratch(spark, "t")
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, rows = rows.collect(), scratch.put(f(spark, rows, ""), name)
        assert rows.columns == odd.columns
        after = rows.collect()
        if name == "quality_rules":
            good = [r for r in before if (s := plain_stats(r["text"]))[0] >= 50 and 2 * s[4] <= s[0]]
            assert Counter(after) == Counter(good)
        if name == "line_dedup":
            assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in after) == Counter({(k[0], k[3]): n for k, n in plain_lines([(r["doc_id"], r["text"]) for r in before]).items()})
        if name == "near_dedup":
            plain = near_classes([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, n, c in plain if n} | {i for i, n, _ in plain if not n})
        if name == "mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    packed = stages["packing"](spark, rows, "")
    assert packed.select("doc_id", "piece").where("piece = 0").count() == rows.count()
