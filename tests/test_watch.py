import time
from collections import namedtuple

from fathom.plans.catalog import QUERIES
from fathom.streaming import watch


def test_decisions():
    assert watch.decide(None, None, "d", False) == "idle"
    assert watch.decide(None, None, "d", True) == "settling"
    assert watch.decide("d", None, "d", True) == "rebuild"
    assert watch.decide("d", "d", "d", True) == "skip"


def test_stream_equals_batch(spark, tmp_path):
    digests = "aabbbaaacacccb"
    rows = [(t, i, d, not (t == "y" and i % 5 == 0)) for t in ("x", "y", "z") for i, d in enumerate(digests if t != "z" else "aaab")]
    df = spark.createDataFrame(rows, "target string, seq long, digest string, work boolean")
    for part in range(3):
        df.where(f"seq between {part * 5} and {part * 5 + 4}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = watch.steps(stream).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table("steps").collect())
    assert got == sorted(tuple(r) for r in watch.steps_of_batch(df).collect())
    want, previous, acted = [], {}, {}
    for t, i, d, work in sorted(rows):
        step = watch.decide(previous.get(t), acted.get(t), d, work)
        previous[t] = d
        acted[t] = d if step == "rebuild" else acted.get(t)
        want.append((t, i, d, step))
    assert got == want


def test_query_runs(spark):
    assert QUERIES["watch_settle"](spark, "/root/testdata/sf0.001").count() > 0


class Clock:
    """A target's state, timers and time, held by hand."""

    def __init__(self):
        self.now, self.value, self.timers = 0, None, set()
        self.getValueState = lambda name, schema: self
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard
        self.getCurrentProcessingTimeInMs = lambda: self.now
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.settle = watch.Settle(10)
        self.settle.init(self)

    def update(self, value):
        self.value = value

    def read(self, *rows):
        reading = namedtuple("Reading", "seq digest work")
        return [r.step for r in self.settle.handleInputRows(("t",), iter([reading(*r) for r in rows]), self)]

    def until(self, now):
        self.now, out = now, []
        for due in sorted(t for t in self.timers if t <= now):
            self.timers.discard(due)
            info = namedtuple("Info", "getExpiryTimeInMs")(lambda due=due: due)
            out += [(r.digest, r.step) for r in self.settle.handleExpiredTimer(("t",), self, info)]
        return out


def test_one_rebuild_a_digest_after_one_quiet_interval():
    c = Clock()
    assert c.read((1, "a", True)) == ["settling"] and c.until(9) == []
    assert c.read((2, "b", True), (3, "b", True)) == ["settling", "waiting"]  # a change moves the timer
    assert c.until(18) == [] and c.until(19) == [("b", "rebuild")] and c.until(99) == []
    assert c.read((4, "b", True)) == ["skip"] and c.until(200) == []
    assert c.read((5, "c", True)) == ["settling"] and c.read((6, "b", True)) == ["skip"] and c.until(300) == []  # back in time: nothing to do
    assert c.read((7, "d", True), (8, "d", False)) == ["settling", "idle"] and c.until(400) == []
    assert c.read((9, "d", True)) == ["settling"] and c.until(410) == [("d", "rebuild")] and not c.timers


def test_stream_acts_without_a_next_reading_and_after_a_restart(spark, tmp_path):
    name, provider = watch.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    schema = "target string, seq long, digest string, work boolean"
    got = []

    def start(quiet):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = watch.acts(stream, quiet).writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect()))
        return out.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()

    def feed(part, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / part))

    def wait(done, q, seconds=90):
        end = time.time() + seconds
        while not done() and time.time() < end and q.isActive:
            time.sleep(0.2)
        assert done(), got

    rebuilt = lambda: [r for r in got if r[3] == "rebuild"]
    feed("0", [("x", 1, "a", True), ("y", 1, "p", False)])
    try:
        q = start(1500)
        try:
            wait(rebuilt, q)
            assert rebuilt() == [("x", 1, "a", "rebuild")] and ("y", 1, "p", "idle") in got
            feed("1", [("x", 2, "a", True), ("y", 2, "q", True)])
            wait(lambda: ("y", 2, "q", "settling") in got and ("x", 2, "a", "skip") in got, q)
        finally:
            q.stop()
        q = start(1500)
        feed("2", [("z", 1, "m", False)])  # y has no next reading: its timer was in the checkpoint
        try:
            wait(lambda: len(rebuilt()) == 2, q)
            time.sleep(2)
        finally:
            q.stop()
        assert sorted(rebuilt()) == [("x", 1, "a", "rebuild"), ("y", 2, "q", "rebuild")]
    finally:
        spark.conf.set(name, before)
