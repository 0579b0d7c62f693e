"""Source trees under any form of root, and results that reach a stream out of order."""

import datetime
import random

from pyspark.sql import functions as F

from corpuslens.sources.corpus import read_corpus
from corpuslens.streaming import watch


def test_roots_of_any_form_give_equal_rows(spark, tmp_path):
    files = {"src/b.ts": "b\nc", "src/a.ts": "a", "a b/ü%41.py": "x", "src/deep/er/c.ts": "\n\n", "z.md": "end"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sources.link./in", f"file://{tmp_path}")
    roots = [f"{tmp_path}", f"{tmp_path}/", f"file:{tmp_path}", f"file://{tmp_path}/", "viewfs://sources/in"]
    want = [(i, p, files[p], len(files[p].encode()), files[p].count("\n") + 1) for i, p in enumerate(sorted(files))]
    for root in roots:
        got = read_corpus(spark, root, 7).select("file_seq", "path", "content", "size_bytes", "lines_of_code", "project_id").collect()
        assert sorted(tuple(r)[:5] for r in got) == want, root
        assert {r.project_id for r in got} == {7}
    assert [r.path for r in read_corpus(spark, roots[-1], pattern="*.py").collect()] == ["a b/ü%41.py"]
    (tmp_path / "none").mkdir()
    assert read_corpus(spark, f"{tmp_path}/none").count() == 0


def test_results_out_of_order_end_as_the_batch_says(spark, tmp_path):
    r = random.Random(5)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = []
    for i in range(160):
        found = r.choice([0, 0, 2, 5])
        rows.append((i, start + datetime.timedelta(minutes=i), i % 2, f"f{r.randrange(6)}", found, found == 0 and r.random() < 0.5))
    want = {(x.project_id, x.path): (x.n_findings, x.seq, x.first_seq) for x in watch.latest_findings(spark.createDataFrame(rows, watch.RESULT_SCHEMA)).collect()}
    # each result up to 40 minutes late, in ten micro-batches
    late = sorted(rows, key=lambda x: x[0] + r.randrange(40))
    assert late != rows
    for k in range(10):
        part = spark.createDataFrame(late[16 * k : 16 * k + 16], watch.RESULT_SCHEMA).coalesce(1)
        part.write.parquet(f"{tmp_path}/in/{k}")
    schema, seen, batches = watch.RESULT_SCHEMA, {}, []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def keep(df, batch):
        batches.append(batch)
        seen.update({(x.project_id, x.path): (x.n_findings, x.seq, x.first_seq) for x in df.collect()})

    live = watch.latest_stream(source).select("project_id", "path", "n_findings", "seq", "first_seq", F.unix_micros("first_seen"))
    query = live.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(batches) >= 10 and {k: v for k, v in seen.items() if v[0]} == want
