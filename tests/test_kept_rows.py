"""Nothing is lost or changed: late arrivals, unknown keys, large and small cases, broken files."""

import pytest
from pyspark.sql import functions as F

from casetrail.functions import text, values
from casetrail.operators import cases, documents, graph, kpi, numbering, routing, signoff, visibility
from casetrail.plans.templates import TemplateSet
from casetrail.sources import commits, files, intake
from casetrail.streaming import intake as streams
from helpers import make_log, rows

PAYLOAD = '{"processKey": "p", "id": "%s", "step_key": "s", "uuid": "u", "occurred_at": "2026-01-05T00:00:00Z"}'


def payloads(spark, path, *arrivals):
    data = [(PAYLOAD % key, day, n) for n, (key, day) in enumerate(arrivals)]
    df = spark.createDataFrame(data, "payload string, received_at string, event_id long")
    df.withColumn("received_at", F.col("received_at").cast("timestamp")).write.mode("append").parquet(path)


def test_late_arrivals_stay_and_repeats_do_not(spark, tmp_path):
    src, log, mark = (str(tmp_path / n) for n in ("src", "log", "mark"))
    for batch in ([("e1", "2026-01-10")], [("e2", "2026-01-05"), ("e2", "2026-01-06")], [("e3", "2026-01-11"), ("e1", "2025-12-01")]):
        payloads(spark, src, *batch)
        streams.stream_intake(streams.payload_stream(spark, src), log, mark).awaitTermination()
    assert rows(spark.read.parquet(log), "external_event_key") == [("e1",), ("e2",), ("e3",)]


def test_a_dry_run_shows_only_what_is_new(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.range(3).write.mode("append").parquet(src)
    schema = spark.range(1).schema
    assert streams.incremental_batches(spark, src, schema, out, mark, dry_run=True).count() == 3
    streams.incremental_batches(spark, src, schema, out, mark).awaitTermination()
    spark.range(10, 12).write.mode("append").parquet(src)
    assert rows(streams.incremental_batches(spark, src, schema, out, mark, dry_run=True), "id") == [(10,), (11,)]


def test_streamed_instances_know_cases_without_uuid(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    events = make_log(spark, {"a": [("s", "08:00")], "b": [("s", "09:00"), ("t", "09:10")]})
    events = events.withColumn("document_uuid", F.when(F.col("document_uuid") == "a", "a"))
    events.write.parquet(log)
    streams.stream_instances(log, events.schema, out, mark, spark).awaitTermination()
    got = streams.current_instances(spark, out)
    assert rows(got, "case_identity", "event_count") == rows(cases.build_instances(events), "case_identity", "event_count") == [("external:b", 2), ("uuid:a", 1)]


def test_streamed_instances_equal_one_run_whatever_the_order(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    steps = {k: [(f"s{i}", f"{8 + i}:0{i}") for i in range(6)] for k in "abcd"}
    events = make_log(spark, steps).withColumn("event_phase", F.when(F.col("event_id") % 4 == 0, "before").otherwise("after"))
    parts = [events.filter(F.pmod(F.hash("event_id"), F.lit(7)) == i) for i in range(7)]
    for n, part in enumerate([*parts, parts[2], parts[0].limit(0)]):  # one part arrives twice
        part.coalesce(1).write.mode("append").parquet(log)
        streams.stream_instances(log, events.schema, out, mark, spark).awaitTermination()
        streams.compact_instances(spark, out, n, fan=3)
    folders = streams._state_folders(spark, out)
    assert len(folders) < 6 and folders[0] == (0, 2)
    columns = ["case_identity", "started_at", "last_event_at", "current_step_key", "event_count"]
    whole = rows(cases.build_instances(events.unionByName(parts[2])), *columns)
    assert rows(streams.current_instances(spark, out), *columns) == whole
    # a merge that was cut short leaves no trace, a repeated one changes nothing
    cases.instance_state(events).write.parquet(f"{out}/batches=0-90")
    (tmp_path / "out" / "batches=0-90" / "_SUCCESS").unlink()
    streams.compact_instances(spark, out, 3, fan=3)
    assert rows(streams.current_instances(spark, out), *columns) == whole


def test_names_are_found_however_deep(spark):
    deep = '"Ada [x"'
    for n in range(30):
        deep = f"[{deep}]" if n % 2 else f'[{{"k": {deep}}}, "n{n} {{"]'
    texts = [deep, '{"name": "Bo", "id": 3}', '[{"id": 3}, {"name": ["x"], "id": "Cy"}, {"name": null, "k": [["Di"]]}]', '"[[[[\\"Ed\\"]]]]"', "[[], {}]"]
    df = spark.createDataFrame([(i, f'{{"f": {t}}}') for i, t in enumerate(texts)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(signoff.name_set(values.field(values.as_object(F.col("c")), "f"))).collect()]
    assert got[0][0] == "Ada [x" and set(got[0][1:]) == {f"n{n} {{" for n in range(0, 30, 2)}
    assert [sorted(x) for x in got[1:]] == [["3", "Bo"], ["3", "Cy", "Di"], ["Ed"], []]


def test_large_and_small_groups_are_numbered_alike(spark):
    data = [(None if i % 4 == 0 else i % 3, None if i % 5 == 0 else i, i) for i in range(40)]
    df = spark.createDataFrame(data, "k int, o int, i int")
    small = rows(cases.numbered(df, ["k"], ["o", "i"]), "i", "pos")
    spark.conf.set(cases.HOT_CONF, "5")
    try:
        large = cases.numbered(df, ["k"], ["o", "i"])
        assert [(i, p) for i, p in rows(large, "i", "pos")] == small
        log = make_log(spark, {"a": [(f"s{i}", f"08:{i:02d}") for i in range(20)]})
        assert "block" not in cases.order_timeline(log).columns
    finally:
        spark.conf.unset(cases.HOT_CONF)


def test_values_are_carried_over_ranges_and_unknown_keys(spark):
    data = [(None if i % 2 else 1, f"{i:03d}", "v" if i in (0, 1) else None, i) for i in range(60)] + [(1, "zz", None, 99)] * 20
    df = spark.createDataFrame(data, "k int, at string, v string, i int").repartition(3)
    seen = []
    for limit in ("1000", "5"):
        spark.conf.set(cases.HOT_CONF, limit)
        try:
            n = numbering.numbered(df, ["k"], ["at", "i"])
            last = numbering.with_last_known(n, F.col("v"), "last", keys=["k"], order=["at", "i"])
            both = numbering.with_neighbours(n, {"after": "i"}, {"ahead": "i"}, keys=["k"], order=["at", "i"])
            counted = documents.row_counter(df, ["at", "i"])
            assert last.filter("last = 'v'").count() == 80
            seen.append([sorted(map(repr, n.select("k", "i", "pos").collect())), sorted(map(repr, both.select("k", "pos", "i", "after", "ahead").collect())), rows(counted, "counter", "at")])
        finally:
            spark.conf.unset(cases.HOT_CONF)
    assert seen[0] == seen[1]


def test_numbering_runs_nothing_while_it_is_planned(spark, tmp_path):
    log = make_log(spark, {"a": [("s", "08:00"), ("t", "09:00")]})
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    cases.order_timeline(log), documents.row_counter(log, ["step_key"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


def test_files_without_an_array_are_reported(spark, tmp_path):
    for name, body in (("a", '[{"x": 1}, 2]'), ("b", "{broken"), ("c", "[]"), ("d", '{"x": 1}')):
        (tmp_path / f"{name}.json").write_text(body)
    got = files.read_event_files(spark, str(tmp_path / "*.json"))
    assert sorted((r.file[-6], r.payload, r.error) for r in got.collect()) == [
        ("a", "2", None), ("a", '{"x":1}', None), ("b", None, "invalid_json"), ("d", None, "invalid_json"),
    ]


def test_one_case_is_removed_and_other_folders_stay(spark, tmp_path):
    path = str(tmp_path / "log")
    both = make_log(spark, {"a": [("s", "08:00")], "b": [("s", "09:00")]}).unionByName(make_log(spark, {"a": [("s", "08:00")]}, process="q"))
    files.append_event_log(both, path)
    assert files.remove_from_log(spark, path, "p", "a") == 1 and files.remove_from_log(spark, path, "q") == 1
    assert rows(files.read_event_log(spark, path), "process_key", "document_uuid") == [("p", "b")]
    unknown = spark.createDataFrame([(None, "a"), ("p", "a")], "process_key string, document_uuid string")
    assert files.delete_process_data(unknown, "p")[0].count() == 1


def test_a_log_reads_as_before_until_a_version_is_in_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log = make_log(spark, {"a": [("s", "08:00")], "b": [("s", "09:00")]}, process="007")
    files.append_event_log(log, path)
    before = rows(files.read_event_log(spark, path), "process_key", "document_uuid")
    assert before == [("007", "a"), ("007", "b")]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits, "_put", killed)
        for work in (lambda: files.append_event_log(log, path), lambda: files.remove_from_log(spark, path, "007", "a")):
            with pytest.raises(KeyboardInterrupt):
                work()
            assert rows(files.read_event_log(spark, path), "process_key", "document_uuid") == before
    with monkeypatch.context() as m:  # ended after the new version, before the old folders went
        m.setattr(commits, "purge", killed)
        with pytest.raises(KeyboardInterrupt):
            files.remove_from_log(spark, path, "007", "a")
    assert rows(files.read_event_log(spark, path), "document_uuid") == [("b",)]
    assert commits.purge(spark, path) == 1 and commits.purge(spark, path) == 0
    assert rows(files.read_event_log(spark, path), "document_uuid") == [("b",)]


def test_writers_of_a_log_do_not_overrun_each_other(spark, tmp_path, monkeypatch):
    path, put, others = str(tmp_path / "log"), commits._put, []
    one = make_log(spark, {"a": [("s", "08:00")], "b": [("s", "09:00")]})
    files.append_event_log(one, path)

    def late(*args):  # another writer is faster once
        if others:
            others.pop()()
        return put(*args)

    monkeypatch.setattr(commits, "_put", late)
    others.append(lambda: files.append_event_log(make_log(spark, {"a": [("s", "10:00")]}).withColumn("extra", F.lit(1)), path))
    assert files.remove_from_log(spark, path, "p", "a") == 1
    assert rows(files.read_event_log(spark, path), "document_uuid", "extra") == [("a", 1), ("b", None)]
    others.append(lambda: files.remove_from_log(spark, path, "p", "b"))
    assert files.remove_from_log(spark, path, "p", "a") == 1
    assert files.read_event_log(spark, path).count() == 0
    with pytest.raises(ValueError, match="another type"):
        files.append_event_log(one.withColumn("event_id", F.lit("x")), path)
    with pytest.raises(ValueError, match="no log"):
        files.remove_from_log(spark, str(tmp_path), "p")


def test_contexts_of_flows_are_whole_and_unknown_ones_have_a_key(spark):
    log = make_log(spark, {"a": [("s", "08:00"), ("t", "09:00"), ("u", "10:00")], "b": [("s", "08:00"), ("t", "09:00")]})
    log = log.withColumn("ctx", F.expr("CASE WHEN step_key = 'u' THEN NULL WHEN document_uuid = 'a' THEN '{\"y\": 1, \"x\": [2]}' ELSE '{\"x\":[2],\"y\":1}' END"))
    none = log.withColumns({"process_key": F.lit(None).cast("string"), "ctx": F.lit("[1]")})
    t = cases.case_timeline(log.unionByName(none), include_before=False, merge_versions=True)
    got = [tuple(r) for r in kpi.flow_by_context(t).collect()]
    whole = '{"x":[2],"y":1}'
    assert sorted(got, key=str) == sorted(
        [("p", "s", "t", whole, 2, 100.0, 1.0), ("p", "t", "u", whole, 1, 50.0, 0.5), (None, "s", "t", "null", 2, 100.0, 1.0), (None, "t", "u", "null", 1, 50.0, 0.5)], key=str
    )
    assert kpi.flow_by_context(t.limit(0)).count() == 0


def test_equal_arrivals_have_one_first(spark):
    log = make_log(spark, {"a": [("s", "08:00")]}).withColumn("event_id", F.lit(None).cast("long"))
    flagged = intake.flag_duplicates(log.unionByName(log).unionByName(log.withColumn("actor_ref", F.lit("x"))))
    assert sorted(r.duplicate for r in flagged.collect()) == [False, True, True]
    assert intake.dedup_events(log.unionByName(log)).select("arrivals").first()[0] == 2


def test_texts_are_trimmed_like_lines(spark):
    df = spark.createDataFrame([("\r\n\t Anna\x0b\0",)], "t string")
    assert df.select(values.trimmed("t")).first()[0] == "Anna"
    names = spark.createDataFrame([('{"n": "Anna\\r\\nBert", "d": [[[[["Cleo"]]]]]}',)], "c string").select(values.as_object(F.col("c")).alias("o"))
    got = names.select(signoff.name_set(values.field(F.col("o"), "n")), signoff.name_set(values.field(F.col("o"), "d"))).first()
    assert list(got) == [["Anna", "Bert"], ["Cleo"]]
    same = spark.createDataFrame([("10.0",), ("10",), ("x",)], "t string").select(text.fmt_if(F.col("t"), [("E", "10", "hit")], "no"))
    assert [r[0] for r in same.collect()] == ["hit", "hit", "no"]


def test_tags_without_a_group_stay(spark):
    tags = spark.createDataFrame([("d", 1, "x", None, None, "a"), ("d", 2, "x", None, None, "b")], "doc_id string, tag_pos int, definition_id string, group_definition string, group_id string, value string")
    assert rows(documents.expand_split_rows(tags), "row_no", "value") == [(0, "b")]


def test_long_member_lists_are_read_to_the_end(spark):
    members = spark.range(600).selectExpr("'p' AS probe_key", "id AS member_pos", "concat('d', id) AS document_uuid")
    seen = spark.createDataFrame([("p", "d599"), ("p", "no")], "probe_key string, document_uuid string")
    probes = spark.createDataFrame([("p", None)], "probe_key string, max_documents int")
    assert rows(visibility.probe_membership(seen, members, probes), "document_uuid", "actual") == [("d599", "visible"), ("no", "hidden")]


def test_templates_may_share_rule_keys(spark):
    log = make_log(spark, {"a": [("s", "08:00")]}, context={"a": {"k": 1}})
    t = cases.case_timeline(log, merge_versions=True).withColumns({"document_version": F.col("event_version"), "ctx": F.col("context")})
    shots = log.selectExpr("document_uuid", "document_version", "process_key", "external_event_key", "occurred_at", "occurred_at AS captured_at", "context").limit(0)
    rule = {"key": "r", "after_step": "s", "expected_process": "z", "when": {"k": 1}}
    both = [{"key": "p", "steps": [{"key": "s"}], "routing": [rule]}, {"key": "q", "process_key": "p", "steps": [{"key": "s"}], "routing": [rule | {"when": {"k": 2}}]}]
    inst = cases.build_instances(log)
    got = routing.cross_process_routing(t, shots, log, inst, TemplateSet(spark, both))
    assert rows(got, "template_key", "status") == [("p", "DEVIATION"), ("q", "NOT_APPLICABLE")]


def test_many_decisions_after_one_step(spark):
    d = [{"key": f"d{i}", "after": "a", "rules": [{"when": {"k": {"eq": i}}, "next": f"t{i}"}, {"else": True, "next": "b"}]} for i in range(20)]
    t = TemplateSet(spark, [{"key": "p", "steps": [{"key": k} for k in ("a", "b", "t3")], "decision_points": d, "field_mappings": {"k": {"stability": "mutable"}}}])
    log = make_log(spark, {"x": [("a", "08:00"), ("t3", "09:00")], "y": [("a", "08:00"), ("t3", "09:00")]}, context={"x": {"k": 3}, "y": {"k": 4}})
    got = graph.project_transitions(cases.case_timeline(log.withColumn("ctx", F.col("context"))), t).filter("to_step IS NOT NULL")
    assert rows(got, "document_uuid", "classification") == [("x", graph.VIA_DECISION), ("y", graph.UNEXPECTED)]
    nodes = {r.node_id: (r.node_type, r.label, r.required) for r in graph.expected_graph(t)[0].collect()}
    assert nodes["a"] == ("task", "a", True) and nodes["decision:d3"][0] == "exclusive_gateway"
