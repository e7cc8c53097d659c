"""Staged tables last as long as their scope says."""

import pytest

from corvane.sources import shared


def there(frame):
    path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.inputFiles()[0])
    return path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).exists(path)


def test_scopes(spark):
    rows = spark.range(10)
    kept = shared.staged(rows, "kept")
    with shared.scratch(spark):
        outer = shared.staged(rows, "outer")
        with shared.scratch(spark):
            inner, lasting = shared.staged(rows, "inner"), shared.staged(rows, "lasting", lasting=True)
            assert there(inner)
        assert not there(inner) and there(lasting) and there(outer)
    assert not there(outer) and not there(lasting) and there(kept) and kept.count() == 10
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        failed = shared.staged(rows, "failed")
        1 / 0
    assert not there(failed)
    other = shared.staged(rows, "other")
    shared.discard(spark, kept)
    assert there(other) and not there(kept)


def test_scopes_of_threads_and_sessions(spark):
    import threading

    found, inside, go_on = {}, threading.Event(), threading.Event()

    def other():
        with shared.scratch(spark):
            found["theirs"] = shared.staged(spark.range(3), "theirs")
            inside.set()
            go_on.wait(60)
            found["seen"] = found["theirs"].count()

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    second = spark.newSession()
    with shared.scratch(spark):
        mine = shared.staged(spark.range(4), "mine")
        elsewhere = shared.staged(second.range(5), "elsewhere")
    assert not there(mine) and there(found["theirs"]) and there(elsewhere)
    go_on.set()
    thread.join()
    assert found["seen"] == 3 and not there(found["theirs"])
    shared.release(second)
    assert not there(elsewhere)
    assert all(spark.conf.get(name, None) in (None, "67108864b") for name in shared._WRITING)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_settings_of_queries_that_are_written(spark):
    before = {name: spark.conf.get(name, None) for name in shared._WRITING}
    with shared.writing(spark), shared.writing(spark):
        assert {name: spark.conf.get(name) for name in shared._WRITING} == shared._WRITING
    assert {name: spark.conf.get(name, None) for name in shared._WRITING} == before


def test_python_gets_small_batches_of_what_is_staged(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    rows = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 500000) AS text").mapInArrow(sizes, "bytes long")
    assert rows.count() == 1
    found = [r.bytes for r in shared.staged(rows, "sizes").collect()]
    assert len(found) > 3 and max(found) <= 9_000_000 and sum(found) >= 32_000_000


def test_staged_tables_are_read_by_many_tasks(spark, monkeypatch):
    """A table that one task wrote is cut to files of a bounded number of rows, and a query that is written reads them in tasks for all cores."""
    monkeypatch.setattr(shared, "FILE_ROWS", 30)
    table = shared.staged(spark.range(100).coalesce(1), "rows")
    assert len(table.inputFiles()) == 4
    with shared.writing(spark):
        assert spark.conf.get("spark.sql.files.minPartitionNum") == str(2 * spark.sparkContext.defaultParallelism)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
