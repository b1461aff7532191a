"""Files, sinks, model calls and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from folia.operators import calls as C
from folia.operators import manuscripts as M
from folia.plans import job_queries as J
from folia.sources import files as S
from folia.streaming import usage as U


def test_manuscript_scan_and_admission(spark, small, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.docx").write_bytes(J._docx("one\ntwo"))
    (folder / "b.pdf").write_bytes(b"%PDF-1")
    (folder / "c.pdf").write_bytes(b"oops")
    (folder / "d.txt").write_bytes(b"x")
    files = S.read_manuscripts(spark, str(tmp_path / "in"))
    reasons = {r["path"][-5:]: r["reason"] for r in M.admit(files).select("path", "reason").collect()}
    assert reasons == {".docx": None, "b.pdf": None, "c.pdf": "content does not match type"}
    assert M.admit(files, max_bytes=1).where("reason = 'too large'").count() == 3
    blocks = S.docx_blocks(files).orderBy("pos").collect()
    assert [(b["kind"], b["text"]) for b in blocks] == [("paragraph", "one"), ("paragraph", "two"), ("table", None), ("image", "cap")]
    assert blocks[2]["rows"] == [["a", "b"]]
    broken = spark.createDataFrame([("x.docx", b"no zip")], "path string, content binary")
    assert S.docx_blocks(broken).first()["kind"] == "error"


def test_batches_to_python_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from folia.functions import batches as B

    files = spark.range(0, 40, 1, 1).select(F.concat("id", F.lit(".docx")).alias("path"), F.encode(F.repeat(F.lit("x"), 500_000), "utf-8").alias("content"))
    S.docx_blocks(files)  # the step sets the limit

    def told(rows):
        for r in rows:
            yield pa.RecordBatch.from_pydict({"n": [r.num_rows], "most": [max(p.num_rows for p in B.pieces(r, 1))], "total": [sum(p.num_rows for p in B.pieces(r, 1))]})

    found = files.mapInArrow(told, "n long, most long, total long").collect()
    assert sum(r["n"] for r in found) == 40 and all(r["n"] == r["total"] for r in found)
    assert max(r["n"] for r in found) <= 10 and max(r["most"] for r in found) == 2
    rows = pa.RecordBatch.from_pydict({"k": range(5), "text": ["ab", None, "c" * 9, "", "d"]})
    assert [p.column(0).to_pylist() for p in B.pieces(rows, 1, 3)] == [[0, 1], [2], [3, 4]]
    assert list(B.pieces(rows.slice(0, 0), 1)) == []


def test_sinks_and_pages(spark, tmp_path):
    spark.createDataFrame([(1, "<?xml v?><article/>")], "doc_id bigint, xml string").createOrReplaceTempView("x")
    S.write_xml(spark.table("x"), str(tmp_path / "xml"))
    assert spark.read.parquet(str(tmp_path / "xml")).first()["xml"].endswith("\n<article/>")
    S.write_json(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["t"] == "é"
    spark.createDataFrame([(1, 0, "t")], "doc_id bigint, page_no int, text string").write.parquet(str(tmp_path / "pages"))
    assert S.read_pages(spark, str(tmp_path / "pages")).count() == 1


def test_calls_retry_rate_limits_only(spark, tmp_path):
    def fn(prompt):
        if prompt == "limit":
            raise C.RateLimit("slow down")
        if prompt == "bad":
            raise ValueError("boom")
        return {"text": prompt, "finish_reason": "stop"}

    df = spark.createDataFrame([("a",), ("limit",), ("bad",)], "prompt string")
    out = {r["prompt"]: (r["text"], r["error_class"]) for r in C.call_model(df, fn, 2, retries=2, wait=0).collect()}
    assert out == {"a": ("a", None), "limit": (None, "rate_limit"), "bad": (None, "other")}


def test_calls_stand_where_their_rows_are_unless_they_are_bounded(spark):
    df = spark.range(0, 60, 1, 12).select(F.concat(F.lit("p"), "id").alias("prompt"))
    answer = lambda prompt: {"text": prompt, "finish_reason": "stop"}
    assert C.call_model(df, answer).rdd.getNumPartitions() == 12 and C.call_model(df, answer, 3).rdd.getNumPartitions() == 3
    assert C.call_model(df, answer).where("text = prompt").count() == 60
    with pytest.raises(ValueError):
        C.call_model(df, answer, limited=True)


def test_stitch_stops_where_an_answer_is_whole(spark):
    rows = [(1, 0, "a", "length"), (1, 1, "```xml\nb\n```", "stop"), (1, 2, "c", "stop"), (2, 0, "x", "STOP"),
        (2, 1, "y", "stop")] + [(3, k, str(k), "MAX_TOKENS") for k in range(6)]
    out = {r["call_id"]: (r["text"], r["rounds"]) for r in C.stitch(spark.createDataFrame(rows, "call_id int, round int, text string, finish_reason string")).collect()}
    assert out == {1: ("a\nb", 2), 2: ("x", 1), 3: ("0\n1\n2\n3", 4)}


def test_late_rows_are_left_out_and_replays_dropped(spark, tmp_path):
    def rows(*pairs):
        data = [(i, datetime.datetime(2024, 1, d, 12), 1, "o", "m", "p", 1, 1, 2) for i, d in pairs]
        return spark.createDataFrame(data, U.USAGE).coalesce(1)

    path = str(tmp_path / "in")
    for part in (rows((1, 1), (2, 2)), rows((2, 2), (3, 9)), rows((4, 1), (5, 20))):
        part.write.mode("append").parquet(path)
    once = U.drained(U.stream_dedupe(U.read_usage(spark, path), "30 days"), str(tmp_path / "c1"), str(tmp_path / "once"))
    assert sorted(r["usage_id"] for r in once.collect()) == [1, 2, 3, 4, 5]
    daily = U.drained(U.stream_usage_daily(U.read_usage(spark, path)), str(tmp_path / "c2"), str(tmp_path / "daily"))
    found = {str(r["day"]): r["requests"] for r in daily.collect()}
    # Row 4 comes when the first of January is closed; the last day stays open.
    assert found["2024-01-01"] == 1 and found["2024-01-09"] == 1 and "2024-01-20" not in found


def test_alerts_come_once_and_closed_days_leave_the_state(spark, tmp_path):
    def rows(first, n, d):
        data = [(first + k, datetime.datetime(2024, 1, d, 12), 1, "o", "gemini-2.5-pro", "p", 1, 1, 2) for k in range(n)]
        return spark.createDataFrame(data, U.USAGE).coalesce(1)

    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    with U.rocksdb(spark):
        # The last rows of the first of January come when that day is closed.
        for part in (rows(0, 21, 1), rows(100, 4, 1), rows(200, 1, 20), rows(300, 30, 1), rows(400, 20, 21)):
            part.write.mode("append").parquet(path)
            found = U.drained(U.stream_alerts(U.read_usage(spark, path)), checkpoint, str(tmp_path / "out"))
        assert sorted((r["day"], r["band"]) for r in found.collect()) == [("2024-01-01", 80), ("2024-01-01", 100), ("2024-01-21", 80)]
        state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
        assert [r["key"]["day"] for r in state.collect()] == ["2024-01-21"]


def test_partitioning_does_not_change_results(spark, small):
    from folia.operators.candidates import clean, leaderboard, score
    from folia.plans.fixtures import view

    cands = view(spark, small, "fx_candidates")
    one, many = (leaderboard(score(clean(cands.repartition(n)))).select("doc_id", "roster_idx", "score", "rank") for n in (1, 16))
    assert one.exceptAll(many).isEmpty() and many.where("rank = 1").count() == one.select("doc_id").distinct().count()
    assert one.where(~F.col("score").between(0, 100)).isEmpty()


def test_windows_let_no_stretch_hold_too_much():
    import random

    rng = random.Random(1)
    for calls, tokens in ((3, 1000), (5, 40), (1, 10)):
        clock = [0.0]
        window = C.Window(calls, tokens, 60.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
        made = []
        for _ in range(200):
            clock[0] += rng.choice([0, 0, 1, 30])
            expected = rng.randint(1, 30)
            window.enter(expected)
            took = rng.randint(1, expected)
            window.used(took)
            made.append((clock[0], took))
        for at, _ in made:
            inside = [t for when, t in made if at <= when < at + 60]
            assert len(inside) <= calls and (sum(inside) <= tokens or len(inside) == 1)


def test_shares_add_up_and_one_client_per_partition(spark):
    opened = spark.sparkContext.accumulator(0)

    def client():
        opened.add(1)
        return lambda prompt: {"text": prompt.upper(), "completion_tokens": 1}

    df = spark.createDataFrame([(f"p{k}", "gemini-2.5-pro") for k in range(60)], "prompt string, model string")
    out = C.call_model(df, None, 3, client=client, limited=True, per=0.05).collect()
    assert sorted(r["text"] for r in out) == sorted(f"P{k}" for k in range(60)) and out[0].asDict().keys() == {"prompt", "model", "text", "finish_reason", "prompt_tokens", "completion_tokens", "error_class"}
    assert opened.value <= 3


def test_a_limit_keeps_the_decoder_from_later_blocks():
    from folia.sources.files import _blocks
    import io
    import zipfile

    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    lines = "".join(f"<w:p><w:r><w:t>{k}</w:t></w:r></w:p>" for k in range(20_000))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{lines}<w:p></w:broken>')
    # The fault at the end is never reached.
    assert [b[1] for b in _blocks(out.getvalue(), 50)] == [str(k) for k in range(50)]
    with pytest.raises(Exception):
        _blocks(out.getvalue())


def test_files_in_one_batch_and_a_batch_that_runs_again(spark, tmp_path):
    from folia.streaming import ingest as I

    drop = tmp_path / "in"
    drop.mkdir()
    for name, content in (("a.xml", "<article></article>"), ("b.xml", "<article></article>"), ("c.xml", "<article><p></article>"), ("d.pdf", "%PDF-1"), ("e.docx", "PK\x03\x04 no zip"), ("f.xml", "x" * 200)):
        (drop / name).write_bytes(content.encode())
    target = str(tmp_path / "out")
    for _ in range(2):  # the second time without the first one's memory, as after a lost commit
        I.stream_files(spark, str(drop), target, str(tmp_path / f"state{_}"), max_bytes=100)
    found = {r["path"][-5:]: (r["status"], bool(r["reason"])) for r in I.manifest(spark, target).collect()}
    assert found == {"a.xml": ("article", False), "b.xml": ("replayed", False), "c.xml": ("broken", True), "d.pdf": ("accepted", False), ".docx": ("broken", True), "f.xml": ("rejected", True)}
    assert spark.read.parquet(f"{target}/articles").count() == 2 and I.manifest(spark, target).count() == 6


def test_contents_of_files_are_not_shuffled_and_few_tasks_look_them_up(spark, tmp_path, monkeypatch):
    from folia.streaming import ingest as I

    kept, tracker = [], spark.sparkContext.statusTracker()
    keep, name = I._Batch.keep, "spark.sql.sources.parallelPartitionDiscovery.parallelism"

    def seen(batch, df):
        kept.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return keep(batch, df)

    monkeypatch.setattr(I._Batch, "keep", seen)
    drop, target, before = tmp_path / "in", str(tmp_path / "out"), spark.conf.get(name, None)
    for k in range(80):
        folder = drop / str(k % 4)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.xml").write_text(f"<article>{k % 60}</article>")
    query = I.stream_files(spark, str(drop), target, str(tmp_path / "state"))
    assert any("content" in columns for columns, _ in kept)
    assert not [1 for columns, plan in kept if "content" in columns and "Exchange" in plan]
    stages = [tracker.getStageInfo(k) for job in tracker.getJobIdsForGroup(str(query.runId)) for k in tracker.getJobInfo(job).stageIds]
    assert max(stage.numTasks for stage in stages if stage) <= I._tasks(spark) < 80 and spark.conf.get(name, None) == before
    status = [r["status"] for r in I.manifest(spark, target).collect()]
    assert (status.count("article"), status.count("replayed")) == (60, 20)


def test_late_rows_are_counted(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([(i, datetime.datetime(2024, 1, d, 12), 1, "o", "m", "p", 1, 1, 2) for i, d in pairs], U.USAGE).coalesce(1)

    path, late = str(tmp_path / "in"), []
    for part in (rows((1, 1), (2, 9)), rows((3, 1), (4, 2), (5, 9))):
        part.write.mode("append").parquet(path)
        run = lambda: U.started(U.stream_dedupe(U.read_usage(spark, path)), str(tmp_path / "state"), str(tmp_path / "out"))
        late.append(sum(r["late"] for r in U.late_rows(spark, run).collect()))
    assert late == [0, 2]


def test_the_scan_finds_empty_files_and_only_whole_ones(spark, tmp_path):
    drop = tmp_path / "in" / "a b" / "sub"
    drop.mkdir(parents=True)
    for name, content in (("a.docx", b"PK"), ("empty.pdf", b""), (".b.docx", b"x"), ("_c.pdf", b"x"), ("d.txt", b"x"), ("E.PDF", b"x")):
        (drop / name).write_bytes(content)
    (tmp_path / "in" / "top.pdf").write_bytes(b"%PDF-1")
    found = S.read_manuscripts(spark, f"file://{tmp_path}/in")
    assert found.columns == ["path", "modificationTime", "length", "content"]
    rows = {r["path"].rpartition("/")[2]: (r["length"], bytes(r["content"])) for r in found.collect()}
    assert rows == {"a.docx": (2, b"PK"), "empty.pdf": (0, b""), "top.pdf": (6, b"%PDF-1")}
    # But for the empty file, what Spark's reader has.
    theirs = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pdf}").option("recursiveFileLookup", True).load(str(tmp_path / "in"))
    columns = ["path", F.date_trunc("second", "modificationTime"), "length", "content"]
    assert sorted(found.where("length > 0").select(columns).collect()) == sorted(theirs.select(columns).collect())
    assert S.read_manuscripts(spark, f"{drop}/*.pdf").count() == 0 and S.shared_folder(spark, f"{drop}/*.pdf") is None
    (tmp_path / "none").mkdir()
    assert S.read_manuscripts(spark, str(tmp_path / "none")).count() == 0


def test_manuscript_scan_of_documents_without_text(spark, tmp_path):
    import os

    from pyspark.sql import Row

    from folia.plans.fixtures import TABLES
    from folia.plans.registry import QUERIES, SQL
    from tests.sql import assert_same

    rows = [(0, "", "en", "s", 0), (1, "é\nx", "en", "s", 3), (2, "y", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for query, found in (("a1_manuscript_scan", docs), ("d20_text_density", docs.where("text is not null"))):
        folder = tmp_path / query
        folder.mkdir()
        for name in TABLES:
            if name != "documents":
                os.symlink(f"/root/testdata/sf0.001/{name}.parquet", folder / f"{name}.parquet")
        found.toPandas().to_parquet(folder / "documents.parquet")
        assert_same(QUERIES[query](spark, str(folder)), SQL[query], str(folder))
    # A file that is written again is never seen half written.
    folder = tmp_path / "drop"
    J.FileDrop(f"file://{folder}")(iter([Row(name="a/x.pdf", content=b"1")]))
    first = (folder / "a" / "x.pdf").stat().st_ino
    J.FileDrop(f"file://{folder}")(iter([Row(name="a/x.pdf", content=b"22")]))
    assert (folder / "a" / "x.pdf").read_bytes() == b"22" and (folder / "a" / "x.pdf").stat().st_ino != first
    assert os.listdir(folder / "a") == ["x.pdf"]


def test_files_are_listed_by_tasks_and_the_stream_keeps_no_entry_for_each(spark, tmp_path):
    import json

    from folia.streaming import ingest as I

    drop, target, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"

    def put(**files):
        for name, content in files.items():
            (drop / name).parent.mkdir(parents=True, exist_ok=True)
            (drop / name).write_text(content)

    def entries():
        return [json.loads(x)["path"] for p in (state / "sources" / "0").iterdir() if p.name.isdigit() for x in p.read_text().splitlines()[1:]]

    put(**{f"{k % 3}/deep/{k}.txt": str(k) for k in range(200)}, **{"0/none.docx": "", "0/a é%20 b.xml": "<article></article>"})
    I.stream_files(spark, f"file://{drop}", target, str(state), per_trigger=100)
    found = {r["path"].rpartition("/")[2]: r["status"] for r in I.manifest(spark, target).collect()}
    assert len(found) == 202 and (found["none.docx"], found["7.txt"], found["a é%20 b.xml"]) == ("rejected", "rejected", "article")
    assert I.manifest(spark, target).count() == 202 and max(r["count"] for r in I.manifest(spark, target).groupBy("batch").count().collect()) <= 100
    assert len(entries()) < 100 and not [p for p in entries() if not p.endswith(".parquet")]
    # What has come is not taken again; what comes is.
    I.stream_files(spark, f"file://{drop}", target, str(state), per_trigger=100)
    assert I.manifest(spark, target).count() == 202
    put(**{"late/b.xml": "<article>b</article>"})
    I.stream_files(spark, f"file://{drop}", target, str(state), per_trigger=100)
    assert [r["status"] for r in I.manifest(spark, target).where("path like '%/late/b.xml'").collect()] == ["article"] and I.manifest(spark, target).count() == 203


def test_a_prompt_goes_to_python_once_for_all_models(spark):
    came = spark.sparkContext.accumulator(0)
    roster = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "roster_idx int, label string")
    docs = spark.createDataFrame([(k, f"p{k}", "x" * 3_000_000) for k in range(4)] + [(9, None, None)], "doc_id long, prompt string, more string")

    def client():
        came.add(1)
        return lambda prompt, label: {"text": f"{prompt}{label}", "completion_tokens": 1} if label else {"error": "429"}

    made = C.call_model(docs.coalesce(1), None, client=client, arguments=("prompt", "label"), roster=roster, without=("prompt", "more"))
    assert made.columns == ["doc_id", "roster_idx", "label", "text", "finish_reason", "prompt_tokens", "completion_tokens", "error_class"]
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()
    found = made.collect()
    spread = C.call_model(docs, None, 3, client=client, arguments=("prompt", "label"), roster=roster, without=("prompt", "more"))
    order = lambda r: (r["doc_id"], r["roster_idx"])
    assert sorted(found, key=order) == sorted(spread.select(made.columns).collect(), key=order)
    assert len(found) == 15 and {r["text"] for r in found if r["doc_id"] == 2} == {"p2a", "p2b", None} and {r["error_class"] for r in found} == {None, "rate_limit"}
    with pytest.raises(ValueError):
        C.call_model(docs, None, client=client, roster=spark.range(1001).withColumnRenamed("id", "label"))
