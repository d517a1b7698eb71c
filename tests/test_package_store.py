import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from trussline.sources import package_store, packages

ENTITIES, RELATIONS = "model/entities.jsonl", "model/relations.jsonl"


def line(name, kind):
    return f'{{"record_id":"{name}","record_type":"{kind}"}}\n'


def archive(folder, name, members, damage=()):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path, text in members.items():
            z.writestr(path, text)
    raw = bytearray(data.getvalue())
    for path in damage:
        at = raw.index(members[path].encode())
        raw[at] ^= 1
    (folder / f"{name}.zip").write_bytes(bytes(raw))


@pytest.fixture
def store(tmp_path):
    for n in range(3):
        archive(tmp_path, f"p{n}", {"manifest.json": "{}", ENTITIES: line(f"e{n}", "entity") * 2 + "\n" + line("stray", "relation"), RELATIONS: line(f"r{n}", "relation")})
    return tmp_path


def opened(reader, monkeypatch):
    names = []
    plain = zipfile.ZipFile.open

    def spy(self, name, *more, **kinds):
        names.append(name if isinstance(name, str) else name.filename)
        return plain(self, name, *more, **kinds)

    monkeypatch.setattr(zipfile.ZipFile, "open", spy)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return names, rows


@pytest.mark.parametrize(
    "filters, names",
    [
        ([EqualTo(("record_type",), "entity")], [ENTITIES] * 3),
        ([In(("record_type",), ("relation", "source"))], [RELATIONS] * 3),
        ([EqualTo(("package_id",), "p1"), EqualTo(("record_type",), "entity")], [ENTITIES]),
        ([StringStartsWith(("path",), "model/r")], [RELATIONS] * 3),
        ([EqualTo(("record_type",), "none")], []),
        ([EqualTo(("json",), "x")], [ENTITIES, RELATIONS] * 3),
    ],
)
def test_filters_open_no_other_member(store, monkeypatch, filters, names):
    reader = package_store.PushingRecordReader({"path": str(store)})
    assert list(reader.pushFilters(filters)) == filters
    assert opened(reader, monkeypatch)[0] == names


def test_planning_opens_no_member(store, monkeypatch):
    monkeypatch.setattr(zipfile.ZipFile, "open", None)
    reader = package_store.FileReader({"path": str(store)})
    assert sum(len(p.members) for p in reader.partitions()) == 9


def test_large_members_have_tasks_of_their_own(store, monkeypatch):
    monkeypatch.setattr(package_store, "TASK_BYTES", 100)
    parts = package_store.FileReader({"path": str(store)}).partitions()
    assert all(len(p.members) == 1 or sum(m.size for m in p.members) <= 100 for p in parts) and len(parts) > 3


def test_records_through_spark(spark, store):
    archive(store, "p9", {ENTITIES: line("e9", "entity"), RELATIONS: line("r9", "relation")}, damage=[RELATIONS])
    (store / "bad.zip").write_bytes(b"no archive")
    rows = package_store.load_records(spark, str(store))
    for entities in (rows.filter("record_type = 'entity'"), package_store.load_records(spark, str(store), record_types=["entity"]), package_store.scan(spark, str(store), "record_type = 'entity'")):
        assert sorted(r.record_id for r in entities.collect()) == ["e0", "e0", "e1", "e1", "e2", "e2", "e9"]
    told = {(r.package_id, r.path, r.line): (r.record_type, r.error) for r in rows.collect()}
    assert told["p0", ENTITIES, 4] == (None, package_store.MISPLACED) and told["p0", ENTITIES, 2] == ("entity", None)
    assert told["p9", RELATIONS, None][1].startswith("ARCHIVE_UNREADABLE") and told["bad", None, None][1].startswith("ARCHIVE_UNREADABLE")
    assert rows.filter("package_id = 'p1' and record_type = 'relation'").count() == 1 and rows.count() == 15
    assert package_store.scan(spark, str(store), "package_id = 'p1'", "package_files").count() == 3


def test_loads_name_what_they_want(spark, store, monkeypatch):
    reader = package_store.RecordReader({"path": str(store), "record_types": '["relation"]', "package_ids": '["p0", "p2"]'})
    assert opened(reader, monkeypatch)[0] == [RELATIONS] * 2


def test_limits(spark, store):
    limits = packages.Limits(members=2)
    assert {r.error for r in package_store.load_files(spark, str(store), limits=limits).collect()} == {"ARCHIVE_TOO_MANY_MEMBERS"}


def files(spark, n=4):
    rows = [(f"q{k}", path, f"{k} {path} ".encode() * (k + 1)) for k in range(n) for path in ("b/two", "a", "c")]
    return spark.createDataFrame(rows, "package_id string, path string, content binary")


def test_packages_written_and_read(spark, tmp_path):
    package_store.write_packages(files(spark), str(tmp_path / "one"))
    package_store.write_packages(files(spark).orderBy(F.rand(3)).repartition(3), str(tmp_path / "two"))
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / t).glob("*.zip")} for t in ("one", "two"))
    assert one == two and len(one) == 4
    back = package_store.load_files(spark, str(tmp_path / "one"))
    assert sorted(map(tuple, back.select("package_id", "path", "content").collect())) == sorted(map(tuple, files(spark).collect()))
    assert zipfile.ZipFile(tmp_path / "one" / "q0.zip").namelist() == ["a", "b/two", "c"]


def test_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    package_store.write_packages(files(spark, 2), target)
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*.zip")}
    with pytest.raises(Exception, match="there already"):
        package_store.write_packages(files(spark, 4), target)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*.zip")} == before
    assert list((tmp_path / "out" / "_writing").iterdir()) == []
    package_store.write_packages(files(spark, 4), target, overwrite=True)
    assert len(list((tmp_path / "out").glob("*.zip"))) == 4


def test_a_failed_task_leaves_no_package(spark, tmp_path):
    broken = files(spark).withColumn("path", F.when(F.col("package_id") == "q3", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("path")))
    with pytest.raises(Exception, match="lost"):
        package_store.write_packages(broken, str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*.zip")) == []


def test_empty_folders(spark, tmp_path):
    assert package_store.load_records(spark, str(tmp_path)).count() == 0
