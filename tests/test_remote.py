"""Models behind a network, with transports that stand in for them."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import remote as M


def test_embeddings_are_batched_and_of_unit_length(spark):
    def embed(texts):
        assert len(texts) <= 3
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(8)], "id int, text string")
    got = {r["id"]: list(r["v"]) for r in M.embeddings(df, embed, 2, batch=3, backoff=0).collect()}
    assert all(got[i] == pytest.approx([i / (i * i + 1) ** 0.5, 1 / (i * i + 1) ** 0.5]) for i in range(8))
    with pytest.raises(Exception, match="dimension 3"):
        M.embeddings(df, embed, 3, batch=3).collect()
    assert M.embedder("hash", 4)(df).where("size(v) = 4").count() == 8
    with pytest.raises(ValueError):
        M.embedder("some-model", 4)


def test_tries():
    calls = []

    def busy_twice():
        calls.append(1)
        if len(calls) < 3:
            raise M.Busy("later")
        return "ok"

    assert M.tried(busy_twice, 3, 0) == "ok"
    with pytest.raises(M.Refused):
        M.tried(lambda: (_ for _ in ()).throw(M.Busy("x")), 2, 0)


def test_answers_are_asked_again_and_failures_are_told(spark):
    def chat(prompt):
        if "refuse" in prompt:
            raise M.Refused("status 400")
        if "prose" in prompt:
            return "no object" if "no JSON object" not in prompt else 'Well: {"a": 1} as asked'
        return '```json\n{"a": 2}\n```' if "fence" in prompt else "never"

    df = spark.createDataFrame([(1, "prose"), (2, "fence"), (3, "refuse"), (4, "else"), (5, None)], "id int, p string")
    got = {r["id"]: (r["answer"], r["answer_error"]) for r in M.answers(df, chat, "p", backoff=0).collect()}
    assert got == {1: ('{"a": 1}', None), 2: ('{"a": 2}', None), 3: (None, "status 400"), 4: (None, "no JSON object"), 5: (None, None)}


def test_judge_is_asked_where_terms_did_not_suffice(spark):
    report = spark.createDataFrame([(1, False, 0.2, ["a"]), (2, True, 0.9, []), (3, False, 0.1, ["b"])], "query_id int, sufficient boolean, coverage_score double, missing array<string>")
    queries = spark.createDataFrame([(1, "why"), (2, "how"), (3, "when")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id int, rank int, text string")
    prompts = {r["query_id"]: r["prompt"] for r in M.judge_prompts(queries, hits).collect()}
    assert prompts == {1: "Question:\nwhy\n\nPassages:\n[1] first\n[2] second", 2: "Question:\nhow\n\nPassages:\n(none)", 3: "Question:\nwhen\n\nPassages:\n(none)"}

    def chat(prompt):
        if "how" in prompt:
            raise AssertionError("a sufficient query is not asked")
        return '{"sufficient": true, "coverage_score": 1.7, "missing": []}' if "why" in prompt else "?"

    got = M.judged(report, M.judge_prompts(queries, hits), chat, backoff=0)
    want = [(1, True, 1.0, [], "heuristic+llm", None), (2, True, 0.9, [], "heuristic", None), (3, False, 0.1, ["b"], "heuristic", "no JSON object")]
    assert sorted((r["query_id"], r["sufficient"], r["coverage_score"], list(r["missing"]), r["level"], r["answer_error"]) for r in got.collect()) == want


def test_patches_change_what_they_prove(spark):
    exps = spark.createDataFrame([("d", u, "A", ["A"], [], ["x"], "q", "h", [], ["A"]) for u in ("f01", "f02")], "doc_id string, unit string, intervention string, experimental_groups array<string>, control_groups array<string>, dependent_variables array<string>, research_question string, hypothesis string, subjects array<string>, independent_variables array<string>")
    cons = spark.createDataFrame([("d", u, 1, "A increases x.", "causal", "e1", []) for u in ("f01", "f02")], "doc_id string, unit string, c int, statement string, relationship string, evidence_id string, interpretation_ids array<string>")
    evidence = spark.createDataFrame([("d", u, 1, "e1", "A increased x by 30% and y rose.") for u in ("f01", "f02")], "doc_id string, unit string, n int, evidence_id string, text string")

    def chat(prompt):
        cite = "e1" if '"f"' not in prompt else "e9"
        return json.dumps({"intervention": "A plus", "control_groups": ["none"], "subjects": [], "conclusions": [{"statement": "A increases x.", "evidence_ids": ["e1"]}, {"statement": "A increases y by 30%.", "direction": "increase", "relationship": "causal", "evidence_ids": [cite]}]})

    proposed = M.patches(exps, evidence, chat, backoff=0)
    bad = F.transform("patch.conclusions", lambda c: c.withField("evidence_ids", F.array(F.lit("e9"))))
    proposed = proposed.withColumn("patch", F.when(F.col("unit") == "f02", F.col("patch").withField("conclusions", bad)).otherwise(F.col("patch")))
    out, told, why = M.patched(exps, cons, evidence, proposed)
    got = {r["unit"]: (r["intervention"], list(r["control_groups"]), list(r["experimental_groups"])) for r in out.collect()}
    assert got == {"f01": ("A plus", ["none"], ["A"]), "f02": ("A", [], ["A"])}
    assert sorted((r["unit"], r["c"], r["statement"]) for r in told.collect()) == [("f01", 1, "A increases x."), ("f01", 2, "A increases y by 30%."), ("f02", 1, "A increases x.")]
    assert [(r["unit"], r["rejected"]) for r in why.collect()] == [("f02", "unknown evidence cited")]


def test_translations_must_keep_the_statement(spark):
    rows = [("d", "1", "Treatment A increases gene X expression.", "RESULT_INTERPRETATION"), ("d", "2", "Treatment A decreases gene X expression.", "RESULT_INTERPRETATION")]
    df = spark.createDataFrame(rows, "doc_id string, draft_id string, statement string, question_type string")
    got = {r["draft_id"]: (r["statement_zh"], r["method"]) for r in M.translated(df, lambda p: '{"zh": "处理 A 使基因 X 的表达提高。"}', backoff=0).collect()}
    assert got["1"] == ("处理 A 使基因 X 的表达提高。", "llm") and got["2"][1] == "template"


def test_objects_are_words_of_the_text(spark):
    bps = spark.createDataFrame([("d", "b1", "DATA_STATEMENT", "5 mM", "Too short.", ["e1"]), ("d", "b2", "DATA_STATEMENT", "7 mM", "Too short.", ["e1"])], "doc_id string, blueprint_id string, question_type string, data_value string, sentence string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("d", "e1", "glucose was 5 mM and salt was 7 mM")], "doc_id string, evidence_id string, text string")
    got = {r["blueprint_id"]: (r["object"], r["refused"]) for r in M.objects(bps, evidence, lambda p: '{"object": "glucose"}' if "5 mM measure" in p else '{"object": "sugar"}', backoff=0).collect()}
    assert got == {"b1": ("glucose", None), "b2": (None, "rejected")}


def counted(folder, reply):
    """A chat that leaves a line for each call in a file of the prompt's name."""
    import hashlib
    import os

    def chat(prompt):
        fd = os.open(os.path.join(folder, hashlib.md5(prompt.encode()).hexdigest()), os.O_CREAT | os.O_APPEND | os.O_WRONLY)
        os.write(fd, b"x")
        os.close(fd)
        return reply(prompt)

    return chat


def calls(folder):
    return sorted(len(f.read_bytes()) for f in folder.iterdir())


def test_a_prompt_is_paid_once_through_copies_second_reads_and_failed_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "WAVE", 10)
    seen, store = tmp_path / "seen", f"file://{tmp_path}/store"
    seen.mkdir()
    df = spark.createDataFrame([(i, f"prompt {i % 40}") for i in range(400)], "id int, p string").repartition(7)
    good = counted(seen, lambda p: json.dumps({"n": int(p.split()[1])}))

    def fails(prompt):
        if prompt == "prompt 33":
            raise MemoryError("the task goes down")
        return good(prompt)

    with pytest.raises(Exception, match="goes down"):
        M.answers(df, fails, "p", backoff=0, store=store, model="m")
    before = calls(seen)
    assert 0 < len(before) < 40  # waves before the failure are kept; its own wave is asked again
    kept = M.kept_answers(spark, f"{store}/{__import__('hashlib').sha256(b'm').hexdigest()[:16]}").count()
    rows = M.answers(df, good, "p", backoff=0, store=store, model="m")
    assert rows.count() == 400 and {json.loads(r["answer"])["n"] == r["id"] % 40 for r in rows.collect()} == {True}
    assert len(calls(seen)) == 40 and sum(calls(seen)) <= 40 + (len(before) - kept)
    after = calls(seen)
    assert M.answers(df, good, "p", backoff=0, store=store, model="m").where("answer is null").count() == 0 and calls(seen) == after
    M.answers(df.limit(1), good, "p", backoff=0, store=store, model="another")
    assert sum(calls(seen)) == sum(after) + 1


def test_calls_that_failed_are_asked_again_by_the_next_run(spark, tmp_path):
    store, df = f"file://{tmp_path}/store", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, p string")

    def busy(prompt):
        if prompt == "a":
            raise M.Busy("status 503")
        return "prose" * (20_000 if len(prompt) == 1 else 1)

    got = {r["id"]: r["answer_error"] for r in M.answers(df, busy, "p", attempts=2, backoff=0, store=store).collect()}
    assert got == {1: "failed after 2 attempts: status 503", 2: "answer too long", 3: None}
    got = {r["id"]: (r["answer"], r["answer_error"]) for r in M.answers(df, lambda p: '{"x": 1}', "p", backoff=0, store=store).collect()}
    assert got == {1: ('{"x": 1}', None), 2: (None, "answer too long"), 3: (None, None)}


def test_a_patch_is_checked_in_full(spark):
    exps = spark.createDataFrame([("d", u, "A", ["A"], [], ["x"], "q", "h", [], ["A"]) for u in "abcde"], "doc_id string, unit string, intervention string, experimental_groups array<string>, control_groups array<string>, dependent_variables array<string>, research_question string, hypothesis string, subjects array<string>, independent_variables array<string>")
    cons = spark.createDataFrame([], "doc_id string, unit string, c int, statement string, relationship string, evidence_id string, interpretation_ids array<string>")
    evidence = spark.createDataFrame([("d", u, 1, "e1", "A decreased x by 30% (p < 0.05).") for u in "abcde"], "doc_id string, unit string, n int, evidence_id string, text string")
    told = {
        "a": {"hypothesis": "A acts at 30%"},
        "b": {"intervention": "A at 99 mM"},
        "c": {"dependent_variables": ["x", "x after p < 0.01"]},
        "d": {"intervention": "A plus", "conclusions": [{"statement": "A increases x.", "evidence_ids": ["e1"]}]},
        "e": {"conclusions": [{"statement": "A decreases x by 30%.", "evidence_ids": ["e1"]}]},
    }
    proposed = spark.createDataFrame([("d", u, json.dumps(p)) for u, p in told.items()], "doc_id string, unit string, j string").select("doc_id", "unit", F.from_json("j", M.PATCH).alias("patch"))
    out, new, why = M.patched(exps, cons, evidence, proposed)
    got = {r["unit"]: (r["hypothesis"], r["intervention"], list(r["dependent_variables"])) for r in out.collect()}
    assert got == {"a": ("A acts at 30%", "A", ["x"]), **{u: ("h", "A", ["x"]) for u in "bcde"}}
    assert {r["unit"]: r["rejected"] for r in why.collect()} == {"b": "number of a field not in evidence", "c": "p-value of a field not in evidence", "d": "direction not in evidence"}
    assert [(r["unit"], r["statement"]) for r in new.collect()] == [("e", "A decreases x by 30%.")]


def test_objects_stand_in_statements_and_their_translation(spark):
    from tessella.operators import drafts as D
    from tessella.operators import translate as T

    cols = "doc_id string, blueprint_id string, question_type string, figure_id string, panel_id string, data_value string, kind string, sentence string, evidence_ids array<string>, expected_answer string, significance string, direction string, cmp_experimental string, cmp_endpoint string"
    row = ["DATA_STATEMENT", "Figure 2", "", "12%", "percentage", "Cell death rose.", ["e1"], "", "", "", "", ""]
    bps = spark.createDataFrame([("d", f"b{i}", *row) for i in range(4)] + [("d", "b4", *row[:5], "Cell death rose by 12% in all treated plates.", *row[6:])], cols)
    evidence = spark.createDataFrame([("d", "e1", "Gene expression was 12% of the control")], "doc_id string, evidence_id string, text string")

    def chat(prompt):
        return '{"object": "Gene expression"}'

    found = M.objects(bps, evidence, chat, backoff=0)
    assert {r["blueprint_id"] for r in found.collect()} == {"b0", "b1", "b2", "b3"}
    # one good phrase, one that isn't of the texts, one failure, one missing
    mixed = spark.createDataFrame([("d", "b0", "Gene expression", None), ("d", "b1", None, "rejected"), ("d", "b2", None, "error")], "doc_id string, blueprint_id string, object string, refused string")
    counts = M.object_counts(mixed).first()
    assert (counts["tried"], counts["extracted"], counts["rejected"], counts["errors"]) == (3, 1, 1, 1)
    said = D.with_quote(bps.join(mixed, ["doc_id", "blueprint_id"], "left")).withColumn("statement", D.true_statement())
    got = {r["blueprint_id"]: r["statement"] for r in said.collect()}
    assert got["b0"] == "According to Figure 2, the reported percentage for Gene expression is 12%."
    assert got["b1"] == got["b2"] == got["b3"] == "According to Figure 2, the reported percentage is 12%."
    assert got["b4"] == "According to Figure 2, Cell death rose by 12% in all treated plates."
    zh = {r["blueprint_id"]: (r["statement_zh"], r["method"]) for r in T.translate_drafts(said).collect()}
    assert zh["b0"][1] == "template" and zh["b0"][0].startswith("根据Figure 2，论文报告的") and zh["b0"][0].endswith("为 12%。") and "表达" in zh["b0"][0]


def test_statements_behind_any_number_of_anchors(spark):
    from tessella.operators import translate as T

    core = "Treatment A increases gene X expression."
    rows = [(i, "".join(f"According to Figure {k}, " for k in range(1, i + 1)) + core) for i in range(6)]
    rows += [(10, "According to Figure 1, According to Figure 2, the reported percentage is 5%."), (11, "According to Figure 1, "), (12, "According to x, b, According to c, d")]
    got = {r["i"]: (r["statement_zh"], r["method"]) for r in T.translations(spark.createDataFrame(rows, "i int, statement string")).collect()}
    own = got[0][0]
    for i in range(6):
        assert got[i] == ("".join(f"根据Figure {k}，" for k in range(1, i + 1)) + own, "template")
    assert got[10][0] == "根据Figure 1, According to Figure 2，论文报告的百分比为 5%。" and got[10][1] == "template"
    assert got[11][1] == "term_fallback" and got[12] == ("根据x，b, According to c, d", "template")


def test_a_gate_from_settings(spark):
    from tessella.sources.artifacts import Settings

    plain, key = M.gate_of(Settings.from_env({"TESSELLA_EVIDENCE_THRESHOLD": "0.5"})), {"TESSELLA_LLM_KEY": "k", "TESSELLA_LLM_MODEL": "m"}
    judge = M.gate_of(Settings.from_env(key), "file:///answers")
    assert plain.levels == "heuristic" and plain.config.threshold == 0.5 and judge.levels == "heuristic+llm" and judge.chat.system == M.JUDGE and judge.answers == {"store": "file:///answers", "model": "m"}
    with pytest.raises(ValueError):
        M.gate_of(Settings.from_env({"TESSELLA_EVIDENCE_TERM_WEIGHT": "0.9"}))
    queries = spark.createDataFrame([(1, "alpha beta", ["alpha", "beta"]), (2, "gamma", ["gamma"])], "query_id int, query string, tokens array<string>")
    hits = spark.createDataFrame([(1, r, "alpha beta", ["alpha", "beta"], 13.0) for r in (1, 2, 3)], "query_id int, rank int, text string, tokens array<string>, sparse_score double")
    assert {r["query_id"]: (r["sufficient"], r["level"]) for r in plain.evaluate(queries, hits).collect()} == {1: (True, "heuristic"), 2: (False, "heuristic")}
    told = M.Gate(chat=lambda p: '{"sufficient": true, "coverage_score": 0.9, "missing": []}', answers={"backoff": 0}).evaluate(queries, hits)
    assert {r["query_id"]: (r["sufficient"], r["level"]) for r in told.collect()} == {1: (True, "heuristic"), 2: (True, "heuristic+llm")}
