"""The stored findings of a stream of changes equal a batch review of the last contents."""

from corpuslens.operators.detectors import Detector
from corpuslens.streaming import rereview

RULES = [
    Detector("todo", "hygiene", "low", "Open TODO", pattern=r"TODO"),
    Detector("fixme", "hygiene", "high", "Known FIXME", pattern=r"FIXME", penalties={"high": 2.0}),
    Detector("wide", "style", "info", "Long line", predicate="length(line) > 60"),
]
COLUMNS = ["project_id", "path", "line_start", "severity", "title", "description", "agent_name", "score_penalty"]


def rows_of(df, *more):
    return sorted((tuple(r) for r in df.select(*COLUMNS, *more).collect()), key=repr)


def test_stream_equals_a_review_of_the_last_contents(spark, tmp_path):
    steps = [  # contents of changed files, batch by batch; None cannot be read
        {"a.ts": "x\n// TODO one\n// TODO two", "b.ts": "// FIXME\n" + "y" * 80, "c.ts": "clean"},
        {"a.ts": "x\nnothing left", "c.ts": "// TODO late"},
        {"b.ts": None, "d.ts": "FIXME\n\nTODO", "a.ts": "// TODO again", "gone.ts": None},
    ]
    event = "seq long, ts timestamp, path string, kind string"
    for i, step in enumerate(steps):
        events = [(i, None, p, "change") for p in [*step, *list(step)[:1]]]  # one file fires twice
        spark.createDataFrame(events, event).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(event).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = iter(steps)

    def read(paths):
        contents = spark.createDataFrame([(7, p, c) for p, c in next(at).items()], "project_id long, path string, content string")
        return contents.join(paths, "path")

    folder = str(tmp_path / "report")
    q = rereview.rereview_stream(stream, read, RULES, folder, str(tmp_path / "cp"), once=True, buckets=3)
    q.awaitTermination(300)
    assert q.exception() is None
    last = {"a.ts": "// TODO again", "b.ts": steps[0]["b.ts"], "c.ts": "// TODO late", "d.ts": "FIXME\n\nTODO"}
    files = spark.createDataFrame([(7, p, c) for p, c in last.items()], "project_id long, path string, content string")
    got = rows_of(rereview.stored_findings(spark, folder))
    assert got == rows_of(rereview.review_files(files, RULES)) and len(got) >= 5
    # a.ts was clean in between, so it came in again; two files entered before it
    entered = {r["path"]: r["entered"] for r in rereview.stored_findings(spark, folder).collect()}
    assert entered == {"a.ts": 2, "b.ts": 0, "c.ts": 1, "d.ts": 2}
    assert {r["path"] for r in rereview.watched_findings(spark, folder, 3).collect()} == {"a.ts", "c.ts", "d.ts"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "report")
    files = "project_id long, path string, content string"
    first = spark.createDataFrame([(1, f"f{i}.ts", "// TODO") for i in range(12)], files)
    rereview.merge_batch(rereview.review_files(first, RULES), first, folder, 0, 4)
    untouched = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "report").rglob("*.parquet")}
    change = spark.createDataFrame([(1, "f3.ts", "clean"), (2, "f3.ts", "// FIXME")], files)
    found = rereview.review_files(change, RULES)
    seen = []
    for _ in range(3):
        rereview.merge_batch(found, change, folder, 1, 4)
        seen.append(rows_of(rereview.stored_findings(spark, folder), "entered"))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 12
    assert {str(p): p.stat().st_mtime_ns for p in (tmp_path / "report").rglob("version=0/*.parquet")} == untouched
    # buckets without changed files have no second version
    assert 1 <= len(list((tmp_path / "report").glob("bucket=*/version=1"))) <= 2
    # all files of a bucket clean: the newest version says so, older ones do not come back
    everything = spark.createDataFrame([(1, f"f{i}.ts", "") for i in range(12)] + [(2, "f3.ts", "")], files)
    rereview.merge_batch(rereview.review_files(everything, RULES), everything, folder, 2, 4)
    assert rereview.stored_findings(spark, folder).count() == 0
    nothing = everything.limit(0)
    rereview.merge_batch(rereview.review_files(nothing, RULES), nothing, folder, 3, 4)
    assert rereview.stored_findings(spark, folder).count() == 0
