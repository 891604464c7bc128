import json

from pyspark.sql import functions as F

from gristmill.operators import log as L
from gristmill.streaming import incremental as INC


def write_lines(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, records)))


def test_stream_upserts(spark, rows, tmp_path):
    store, landed, check = str(tmp_path / "store"), tmp_path / "landed", str(tmp_path / "check")
    base = rows(INC.LOG_SCHEMA, ("t", "c", 7, None, None, "a", "pending", 1))
    INC.start_log(spark, base, store)

    def run():
        stream = spark.readStream.schema("body STRING, ord BIGINT").json(str(landed))
        INC.stream_upserts(stream, store, check).awaitTermination()
        return {r.url: (r.title, r.status, r.score) for r in INC.read_snapshot(spark, store, INC.LOG_SCHEMA).collect()}

    write_lines(landed, "1.json", [{"body": json.dumps({"url": "a", "status": "applied"}), "ord": 10}])
    assert run() == {"a": ("t", "applied", 7)}
    write_lines(landed, "2.json", [{"body": json.dumps({"url": "b", "title": "n", "score": 3}), "ord": 11}, {"body": json.dumps({"url": "a", "score": 9}), "ord": 12}])
    assert run() == {"a": ("t", "applied", 9), "b": ("n", None, 3)}
    assert run() == {"a": ("t", "applied", 9), "b": ("n", None, 3)}
    assert INC.latest_snapshot(spark, store) == 2 and INC.latest_snapshot(spark, store, 2) == 1
    batch = L.upsert(base, L.parse_updates(spark.read.schema("body STRING, ord BIGINT").json(str(landed))))
    assert {r.url: (r.title, r.status, r.score) for r in batch.collect()} == {"a": ("t", "applied", 9), "b": ("n", None, 3)}


def test_stream_new_postings(spark, rows, tmp_path):
    store, landed, out = str(tmp_path / "store"), tmp_path / "landed", str(tmp_path / "out")
    INC.start_log(spark, rows(INC.LOG_SCHEMA, ("t", "c", 7, None, None, "done", "applied", 1)), store)

    def posting(url, ord):
        return {"title": "t", "url": url, "source_rank": 0, "ord": ord}

    def run():
        stream = spark.readStream.schema("title STRING, url STRING, source_rank INT, ord BIGINT").json(str(landed))
        INC.stream_new_postings(stream, store, out, str(tmp_path / "check")).awaitTermination()
        return sorted((r.url, r.ord) for r in spark.read.parquet(out).collect())

    write_lines(landed, "1.json", [posting("a", 2), posting("a", 1), posting("done", 3), posting("", 4), posting("", 5)])
    assert run() == [("", 4), ("", 5), ("a", 1)]
    write_lines(landed, "2.json", [posting(" a\t", 6), posting("b", 7), posting("", 8)])
    assert run() == [("", 4), ("", 5), ("", 8), ("a", 1), ("b", 7)]


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def everything(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_log_store_over_batches(spark, tmp_path):
    """Deltas follow the batch, a repeated batch changes nothing, compaction touches its buckets and keeps first rows."""
    store, landed = tmp_path / "store", tmp_path / "landed"
    base = spark.range(3000).selectExpr("'t' || id AS title", "uuid() AS company", "CAST(id % 9 AS INT) AS score", "repeat(uuid(), 3) AS cover_letter",
                                        "CAST(NULL AS STRING) AS fit_reason", "CASE WHEN id % 500 = 7 THEN NULL WHEN id % 4 = 0 THEN 'hot' ELSE 'u' || id END AS url",
                                        "'pending' AS status", "id AS ord")
    base.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    INC.start_log(spark, base, str(store))
    start, start_bytes, every = files(store), size(store), []

    def run(check="check", **settings):
        stream = spark.readStream.schema("body STRING, ord BIGINT").json(str(landed))
        INC.stream_upserts(stream, str(store), str(tmp_path / check), **settings).awaitTermination()
        wanted = L.upsert(base, L.parse_updates(spark.read.schema("body STRING, ord BIGINT").json(str(landed))))
        assert everything(INC.read_log(spark, str(store))) == everything(wanted)
        return INC.log_store(spark, str(store))

    def land(*records):
        every.append([{"body": json.dumps(r), "ord": 10_000 + 100 * len(every) + k} for k, r in enumerate(records)])
        write_lines(landed, f"{len(every)}.json", every[-1])

    land({"url": "hot", "status": "applied"}, {"url": None, "score": 3}, {"url": "new", "title": "n"}, {"url": "u5", "cover_letter": None})
    table = run()
    assert {k: v for k, v in files(store).items() if k in start} == start and size(store / "delta") < start_bytes / 10
    land({"url": "new", "score": 1}, {"url": "hot", "score": 99}, {"url": "hot", "score": 98}, {"url": "", "title": "blank is a url of its own"})
    run()
    before = everything(INC.read_log(spark, str(store)))
    # The same batch once more, as after a restart before its commit.
    last = spark.createDataFrame([(r["body"], r["ord"]) for r in every[-1]], "body STRING, ord BIGINT")
    table.write_delta(L.combine_updates(L.parse_updates(last), INC._COLUMNS), table_key(), 2)
    assert everything(INC.read_log(spark, str(store))) == before
    assert everything(INC.read_log(spark, str(store), before=1)) == everything(base.select(*INC._NAMES))
    dirty = INC.compact_log(spark, str(store))
    gens = table.generations()
    assert dirty == sorted(b for b, g in gens.items() if g == 2) and 1 < len(dirty) <= 5 and not table.pending()
    assert everything(INC.read_log(spark, str(store))) == before
    assert everything(INC.read_log(spark, str(store), only=dirty[:1])) == everything(INC.read_log(spark, str(store)).filter(table.bucket(table_key()) == dirty[0]))
    assert table.base().filter("is_first AND url = 'hot'").count() == 1 and {r.ord for r in table.base().filter("is_first AND url = 'hot'").collect()} == {0}
    table.write_delta(L.combine_updates(L.parse_updates(last), INC._COLUMNS), table_key(), 2)
    assert everything(INC.read_log(spark, str(store))) == before
    table.vacuum()
    assert everything(INC.read_log(spark, str(store))) == before and not list((store / "delta").rglob("*.parquet"))
    land({"url": "hot", "title": "third"}, {"url": "new", "title": None})
    run(compact_every=1)
    assert table.batches()[-1] == 3


def table_key():
    return F.col("url")


def test_a_broken_write_does_not_count(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    INC.start_log(spark, rows(INC.LOG_SCHEMA, ("t", "c", 7, None, None, "a", "pending", 1)), store)
    table = INC.log_store(spark, store)
    update = rows("body STRING, ord BIGINT", (json.dumps({"url": "a", "score": 1}), 5))
    table.write_delta(L.combine_updates(L.parse_updates(update), INC._COLUMNS), table_key(), 1)
    INC.compact_log(spark, store)
    for done in (tmp_path / "store" / "base").glob("gen=*1/_SUCCESS"):
        done.unlink()
    assert table.generations().popitem()[1] == 0 and [r.score for r in INC.read_log(spark, store).collect()] == [1]
    (tmp_path / "store" / "delta" / "batch=000000000001" / "_SUCCESS").unlink()
    assert [r.score for r in INC.read_log(spark, store).collect()] == [7]
    assert INC.read_log(spark, str(tmp_path / "none")).count() == 0


def test_ingest_reads_its_own_buckets(spark, rows, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    INC.start_log(spark, rows(INC.LOG_SCHEMA, *[("t", "c", 7, None, None, u, "applied", k) for k, u in enumerate(["done", None, "other"])]), log)
    schema = "title STRING, url STRING, source_rank INT, ord BIGINT"

    def batch(number, *urls):
        INC.ingest_batch(rows(schema, *[("t", u, 0, 100 * number + k) for k, u in enumerate(urls)]), number, log, out)
        return sorted(("none" if r.url is None else r.url, r.ord) for r in spark.read.parquet(out).filter(f"batch = {number}").collect())

    many = [f"u{k}" for k in range(200)]
    assert len(batch(0, *many, "done", None, "", " ", "\t ")) == 203
    keys = INC.key_store(spark, out)
    assert keys.deltas().count() == 200 and len(keys.pending()) > 20
    assert batch(1, " u3\n", " new", "new", "", "u4", "done ") == [("", 103), ("done ", 105), (" new", 101)]
    own = keys.touched(rows("k STRING", ("u3",), ("new",)), F.col("k"))
    read = INC.known_keys(keys, own, 1).inputFiles()
    assert read and {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= set(own)
    again = batch(1, " u3\n", " new", "new", "", "u4", "done ")
    assert again == [("", 103), ("done ", 105), (" new", 101)]
    assert INC.compact_keys(spark, out, 2) and not keys.pending() and keys.base().count() == 202
    assert batch(2, "new", "u9", "fresh", "done") == [("fresh", 202)]
    keys.vacuum()
    assert batch(2, "new", "u9", "fresh", "done") == [("fresh", 202)]
    assert batch(3) == [] and batch(4, "fresh", "last") == [("last", 401)]


def test_ingest_stream_of_three_batches(spark, rows, tmp_path):
    log, landed, out = str(tmp_path / "log"), tmp_path / "landed", str(tmp_path / "out")
    INC.start_log(spark, rows(INC.LOG_SCHEMA, ("t", "c", 7, None, None, "done", "applied", 1)), log)

    def run():
        stream = spark.readStream.schema("title STRING, url STRING, source_rank INT, ord BIGINT").json(str(landed))
        INC.stream_new_postings(stream, log, out, str(tmp_path / "check"), compact_every=2).awaitTermination()
        return sorted((r.url or "", r.ord) for r in spark.read.parquet(out).collect())

    for number, urls in enumerate([["a", "b", None], ["b", "c", ""], ["a ", "c", "d"]]):
        write_lines(landed, f"{number}.json", [{"title": "t", "url": u, "source_rank": 0, "ord": 10 * number + k} for k, u in enumerate(urls)])
        got = run()
    assert got == [("", 2), ("", 12), ("a", 0), ("b", 1), ("c", 11), ("d", 22)] == run()
    assert set(INC.key_store(spark, out).generations().values()) == {1}
