import pytest
from sedimenta.plans.store import Config, Store
from sedimenta.sources.log import RecordLog, SealedError, recover


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_store_keeps_its_state_through_compaction_and_vacuum(spark, tmp_path):
    told = []
    store = Store(spark, str(tmp_path / "s"), Config(level_size=[1, 1 << 30], log_files=1), lambda event, what: told.append(event))
    want = {}
    for lo, hi in ((0, 50), (30, 80), (10, 40), (60, 100)):
        store.put(frame(spark, [(f"key{i:03}", f"v{lo}") for i in range(lo, hi)]))
        want |= {f"key{i:03}": f"v{lo}" for i in range(lo, hi)}
    store.remove(frame(spark, [("key005", None), ("key500", None)]))
    want.pop("key005")
    assert {r.key: r.value for r in store.state().collect()} == want
    n = 0
    while store.compact():
        n += 1
        assert {r.key: r.value for r in store.state().collect()} == want
    assert n >= 3 and told.count("new_tail") == 5 and told.count("compaction_started") == told.count("compaction_completed") == told.count("view_updated") == n
    store.vacuum()
    again = Store(spark, str(tmp_path / "s"))
    assert {r.key: r.value for r in again.state().collect()} == want
    assert again.get("key070") == "v60" and again.get("key005") is None and again.get("nokey") is None
    assert [r.key for r in again.scan("key090", 3).collect()] == ["key090", "key091", "key092"]
    again.put(frame(spark, [("key005", "back")]))
    assert again.get("key005") == "back"
    probes = spark.createDataFrame([("key001",), ("key500",), ("zzz",)], "key string")
    assert {r.probe: r.status for r in again.multi_get(probes).collect()} == {"key001": "OK", "key500": "DELETED", "zzz": "NOT_FOUND"}


def test_log_ranges_sizes_and_seal(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    assert log.tail() == 0 and log.records().count() == 0
    assert log.append(frame(spark, [(f"test_key{i}", f"test_value{i}") for i in range(10)]).coalesce(1), ["key"]) == 1
    assert [r.key for r in log.read(3, 6).orderBy("seq").collect()] == ["test_key3", "test_key4", "test_key5"]
    assert log.append(frame(spark, [("a", "b")])) == 2 and log.read_segment(2).first().key == "a"
    assert {r.segment: r.n_records for r in log.sizes().collect()} == {1: 10, 2: 1}
    log.seal()
    assert log.is_sealed()
    with pytest.raises(SealedError):
        log.append(frame(spark, [("x", "y")]))


def test_config_from_json():
    c = Config.read('{"MAX_LEVEL": 2, "level_size": [6144, 12288], "level_file_size_limit": [1024, 2048], "log_file_number_limit": 3}')
    assert (c.level_size, c.file_size, c.log_files) == ([6144, 12288], [1024, 2048], 3)
    with pytest.raises(ValueError):
        Config.read('{"max_level": 1}')


def test_levels_below_the_listed_ones_grow_and_only_the_last_is_split(spark, tmp_path):
    c = Config(max_level=4, level_size=[1, 1], file_size=[1, 1], log_files=1)
    assert [c.of(c.level_size, i) for i in (1, 2, 3, 4)] == [1, 1, 4, 16]
    store, want = Store(spark, str(tmp_path / "s"), c), {}
    for i in range(4):
        store.put(frame(spark, [(f"k{j}", f"v{i}") for j in range(i, 40)]))
        want |= {f"k{j}": f"v{i}" for j in range(i, 40)}
    outputs = []
    for _ in range(6):
        before = {r["path"] for r in store.manifest()["runs"]}
        if not store.compact():
            break
        outputs.append([r["level"] for r in store.manifest()["runs"] if r["path"] not in before])
    assert outputs and all(len(new) == 1 for new in outputs if new[0] < 4)
    assert {r.key: r.value for r in store.state().collect()} == want
    assert store.manifest()["compacted"] == [1, 2, 3, 4]
    assert store.vacuum() == 3 and store.manifest()["compacted"] == [4]  # the log's numbers go on from the newest
    assert {r.key: r.value for r in store.state().collect()} == want
    store.put(frame(spark, [("k0", "last")]))
    assert store.get("k0") == "last"


def test_numbers_go_on_after_all_segments_are_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Config(max_level=2, level_size=[1, 1 << 30], log_files=1))
    store.put(frame(spark, [(f"k{i}", "old") for i in range(5)]))
    store.put(frame(spark, [(f"k{i}", "newer") for i in range(5)]))
    store.put(frame(spark, [("k0", "x")]).limit(0))
    while store.compact():
        pass
    tail = store.log.tail()
    store.vacuum()
    store.vacuum()
    assert store.log.tail() == tail > 0
    store.put(frame(spark, [("k1", "newest")]))
    assert store.get("k1") == "newest" and store.get("k2") == "newer"


def test_dense_numbers(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    rows = frame(spark, [(f"key{i:03}", str(i)) for i in range(100)]).repartition(7)
    log.append(rows, ["key"], dense=True)
    log.append(rows.limit(0), dense=True)
    log.append(rows, dense=True)
    got = log.records().orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(200)) and [r.key for r in got[:100]] == sorted(r.key for r in got[:100])
    assert {r.segment for r in got} == {1, 3} and log.tail() == 200


def test_an_append_that_ended_in_the_middle_is_removed(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    log.append(frame(spark, [("a", "b")]))
    (tmp_path / "log" / "segment=2").mkdir()
    assert log.records().count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        log.append(frame(spark, [("c", "d")]))
    assert recover(spark, log.path, "segment") == [2] and log.append(frame(spark, [("c", "d")])) == 2
