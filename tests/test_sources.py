import gzip
import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from rowassay.operators.profile import profile
from rowassay.plans.analysis import compare, run_steps
from rowassay.sources import files, structure
from rowassay.sources.digests import sha256_in_pieces
from rowassay.sources.store import ResultStore, profile_from_json, profile_to_json


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def logical(df):
    return [r.logical_type for r in structure.table_columns(df).collect()]


def test_csv_types(spark, tmp_path):
    path = write(tmp_path / "people.csv", "id,name,joined_at,active\n1,a,2024-01-01,true\n2,b,2024-01-02,false\n3,\"c,d\",2024-01-03,true\n")
    df = files.read_csv(spark, path)
    assert logical(df) == ["integer", "string", "date", "boolean"]
    got = structure.table_structure(df, nullable_known=False).orderBy("ordinal_position").collect()
    assert [r.ordinal_position for r in got] == [1, 2, 3, 4] and got[0].row_count == 3 and got[0].nullable is None


def test_csv_numbers_and_mixed(spark, tmp_path):
    assert logical(files.read_csv(spark, write(tmp_path / "n.csv", "a,b\n1,1.5\n2,2.5\n"))) == ["integer", "float"]
    assert logical(files.read_csv(spark, write(tmp_path / "m.csv", "id,value\n1,not-a-number\n2,2\n"))) == ["integer", "string"]


def test_csv_types_follow_the_last_row(spark, tmp_path):
    path = write(tmp_path / "late.csv", "a,b\n" + "1,2\n" * 20_000 + "1.5,x\n")
    df = files.read_csv(spark, path)
    assert logical(df) == ["float", "string"] and df.count() == 20_001


def test_csv_given_schema_fails_fast(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "a\n1\nx\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        files.read_csv(spark, path, schema=T.StructType([T.StructField("a", T.IntegerType())])).collect()


def test_csv_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"two\nlines"\n')
    assert files.read_csv(spark, path, multi_line=True).first().b == "two\nlines"


@pytest.mark.parametrize(
    "header,rules",
    [("id,id", {("duplicate_column_names", 0), ("duplicate_column_names", 1)}), ("id, ", {("blank_column_name", 1)}), ("a,b", set()), ("", {("missing_columns", None)})],
)
def test_header_rules(spark, tmp_path, header, rules):
    path = write(tmp_path / "h.csv", header and header + "\n1,2\n")
    assert {(r.rule, r.position) for r in files.csv_header_violations(spark, path).collect()} == rules


def test_inventory(spark, tmp_path):
    write(tmp_path / "a.csv", "")
    write(tmp_path / "b.csv", "12345")
    write(tmp_path / "c.csv", "1234567890")
    got = {r.file_name: r for r in files.file_inventory(spark, str(tmp_path), max_bytes=6).collect()}
    assert (got["a.csv"].problem, got["b.csv"].problem, got["c.csv"].problem) == ("empty", None, "too_large")
    assert got["b.csv"].sha256 == "5994471abb01112afcc18159f6cc74b4f511b99806da59b3caf5a9c173cacfc5" and got["c.csv"].sha256 is None


@pytest.fixture
def small_reads(spark):
    """No file beyond 1000 bytes can be read whole, and a scan's pieces have 700 bytes."""
    settings = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_inventory_of_files_too_large_for_a_task(spark, tmp_path, small_reads):
    noise = random.Random(7)
    contents = {
        "lines.csv": b"a,b\r\n1,2\n\n" * 300,
        "open [end]{x}*.csv": b"name 100%\n" * 500 + b"last",
        "mark.csv": b"\xef\xbb\xbfid\n" + b"1\n" * 900,
        "noise.parquet": noise.randbytes(5000),
        "feeds.bin": b"\n" * 2000,
        "one_line.json": b"x" * 3000,
        "small.csv": b"\xef\xbb\xbf1",
        "empty.csv": b"",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file_name: (r.size_bytes, r.sha256, r.problem) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest(), None if data else "empty") for name, data in contents.items()}
    limited = {r.file_name: (r.sha256 is None, r.problem) for r in files.file_inventory(spark, str(tmp_path), max_bytes=4000).collect()}
    assert limited["noise.parquet"] == limited["open [end]{x}*.csv"] == (True, "too_large") and limited["mark.csv"] == (False, None)


def test_files_that_cannot_be_cut_have_no_digest_of_pieces(spark, tmp_path, small_reads):
    """Unpacked by the scan, or with a line longer than a task may hold: never a digest of other bytes."""
    lines = b"1234567\n" * 400
    contents = {"fits.txt": lines, "long.txt": lines + b"x" * 900 + b"\n" + lines, "end.txt": lines + b"x" * 900, "packed.gz": gzip.compress(lines * 99)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    sizes = {f"file:{tmp_path}/{name}": len(data) for name, data in contents.items()}
    assert sha256_in_pieces(spark, sizes, longest=300) == {f"file:{tmp_path}/fits.txt": hashlib.sha256(lines).hexdigest()}


def test_large_files_that_cannot_be_cut_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 10)
    data = gzip.compress(b"1234567\n" * 400)
    (tmp_path / "packed.gz").write_bytes(data)
    (tmp_path / "plain [1].txt").write_bytes(b"1\n" * 20)
    got = {r.file_name: r.sha256 for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"packed.gz": hashlib.sha256(data).hexdigest(), "plain [1].txt": hashlib.sha256(b"1\n" * 20).hexdigest()}


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        files.read_table(spark, "x", "xlsx")


def test_versions_and_steps(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(200)], "id bigint, name string")
    second = first.selectExpr("id", "name", "CAST(id AS STRING) AS email")
    assert [store.register(first, "people", " People ", " "), store.register(second, "people", "People")] == [1, 2]
    assert store.read("datasets").collect()[0].name == "People" and store.read("datasets").first().description is None
    assert store.version("people", 1).columns == ["id", "name"] and store.columns("people", 2).count() == 3
    steps = ("profile", "detect", "score", "recommendations", "validations")
    for version in (1, 2):
        assert {r.status for r in run_steps(store, "people", steps, version).collect()} == {"succeeded"}
    last = run_steps(store, "people", ("history", "nonsense"), 2, {"base_version": 1, "target_version": 2}).collect()
    assert [(r.status, r.error_code) for r in last] == [("succeeded", None), ("failed", "unsupported_step")]
    assert last[0].result["has_drift"] == "True"
    same = run_steps(store, "people", ("history",), 2, {"base_version": 1, "target_version": 1}).first()
    assert same.error_code == "same_version"
    assert [r.name for r in store.read("schema_diffs", "people").collect()] == ["email"]
    before = store.read("profiles", "people").count()
    run_steps(store, "people", ("profile",), 1)
    assert store.read("profiles", "people").count() == before + 2
    assert store.latest_profile("people", 1).count() == 2
    kinds = {r.operation_kind for r in store.read("validations", "people").collect()}
    assert {"drop_column", "group_rare_categorical"} <= kinds


def test_clean_table_scores_without_findings(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    store.register(spark.createDataFrame([(i % 40, "abc"[i % 3]) for i in range(120)], "a int, b string").distinct(), "clean", "Clean")
    got = run_steps(store, "clean", ("profile", "detect", "score", "recommendations", "validations"), 1).collect()
    assert [r.status for r in got] == ["succeeded"] * 5
    assert (got[2].result["score"], got[2].result["grade"]) == ("100.0", "A")


def test_runs_without_findings_count(spark, tmp_path):
    """A detect run that finds nothing replaces the findings of the run before."""
    store = ResultStore(spark, str(tmp_path / "store"))
    store.register(spark.createDataFrame([(None if i % 3 == 0 else i % 40, "abc"[i % 3]) for i in range(120)], "a int, b string").distinct(), "t", "T")
    run_steps(store, "t", ("profile",), 1)
    first = run_steps(store, "t", ("detect", "score"), 1, {"threshold": 0.01}).collect()
    second = run_steps(store, "t", ("detect", "score", "recommendations"), 1).collect()
    assert int(first[0].result["finding_count"]) > 0 and float(first[1].result["score"]) < 100
    assert (second[0].result["finding_count"], second[1].result["score"], second[2].result["count"]) == ("0", "100.0", "0")
    assert store.read("runs", "t").count() == 6


def test_ids_keep_their_text(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    for name in ("007", "7", "a/b=c"):
        store.register(spark.range(len(name)).toDF("x"), name, name)
        store.register(spark.range(9).toDF("x"), name, name)
    for name in ("007", "7", "a/b=c"):
        assert [r.version_number for r in store.read("dataset_versions", name).orderBy("version_number").collect()] == [1, 2]
        assert store.version(name, 1).count() == len(name)


def test_history_without_profiles(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    store.register(spark.range(3).toDF("a"), "t", "T")
    store.register(spark.range(3).selectExpr("id AS a", "id AS b"), "t", "T")
    got = run_steps(store, "t", ("history", "detect"), 2, {"base_version": 1, "target_version": 2}).collect()
    assert (got[0].status, got[0].result["has_drift"], got[1].error_code) == ("succeeded", "True", "missing_profile")
    assert [r.name for r in store.read("schema_diffs", "t").collect()] == ["b"]


def test_broken_names_are_not_registered(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="blank_column_name"):
        store.register(spark.range(1).toDF(" "), "t", "T")
    assert not store.exists("dataset_versions")


def test_json_profile(spark):
    rows = profile(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"))
    back = {r.name: r for r in profile_from_json(profile_to_json(rows)).collect()}
    assert back["name"].null_count == 1 and back["id"].numeric.mean == 1.5 and back["name"].top_values[0].value == "a"


def test_same_version_is_an_error(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        compare(df, df, "t")


def test_failed_attempts_leave_nothing_visible(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path / "store"))
    one, two = spark.range(3).selectExpr("id"), spark.range(5).selectExpr("id", "id * 2 AS twice")

    def broken(self, *_):
        raise OSError("disk gone")

    for step in ("_fingerprint", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(ResultStore, step, broken)
            with pytest.raises(OSError):
                store.register(one, "t", "T")
        assert not store.exists("dataset_versions")
    assert store.register(two, "t", "T") == 1
    assert store.columns("t", 1).count() == 2 and store.read("dataset_versions", "t").count() == 1
    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_commit", broken)
        with pytest.raises(OSError):
            store.register(one, "t", "T")
    assert store.register(one, "t", "T") == 2
    assert [r.name for r in store.columns("t", 2).collect()] == ["id"] and store.version("t", 2).count() == 3


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path / "store"))
    # all writers see the same next number, so only the commit record can tell them apart
    monkeypatch.setattr(ResultStore, "next_version", lambda self, dataset_id: 1)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: store.register(spark.range(k + 1), "t", "T"), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4]
    for k, number in enumerate(numbers):
        assert store.version("t", number).count() == k + 1
    assert store.read("dataset_columns", "t").count() == 4 and store.read("datasets").count() == 1


def test_version_hash_size_and_name(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    source = tmp_path / "people.csv"
    source.write_text("id,name\n1,a\n2,b\n")
    digest = hashlib.sha256(source.read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="wrong_sha256"):
        store.register_file(str(source), "csv", "007", "People", sha256="0" * 64)
    with pytest.raises(ValueError, match="too_large"):
        store.register_file(str(source), "csv", "007", "People", max_bytes=3)
    assert store.register_file(str(source), "csv", "007", "People", sha256=digest) == 1
    row = store.read("dataset_versions", "007").first()
    parts = sorted((tmp_path / "store" / "data" / "dataset_id=007" / row.folder).glob("*.parquet"))
    assert (row.original_name, row.row_count, row.size_bytes, row.file_count) == ("people.csv", 2, sum(p.stat().st_size for p in parts), len(parts))
    assert store.intact("007", 1)
    parts[0].write_bytes(parts[0].read_bytes()[::-1])
    (parts[0].parent / f".{parts[0].name}.crc").unlink(missing_ok=True)
    assert not store.intact("007", 1)
