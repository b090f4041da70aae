import csv
import json
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.queries.loading import _as_array
from tidemill.session import new_scratch
from tidemill.sinks.landing import Dataset, TableSpec, land_dataset, land_source, remove_old_versions, save_table
from tidemill.sources.catalog import Layers, layer_databases, list_columns, require_table, table_exists, tables_in
from tidemill.sources import records as records_module
from tidemill.sources.files import _survey, read_delimited, read_json, read_source, sniff_delimiter, text_survey

from conftest import rows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_infers_types(spark, tmp_path):
    df = read_source(spark, write(tmp_path / "a.csv", "id,name,weight\n1,Olm,17.0\n2,Mouse,20.0\n"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("weight", "double")]
    assert rows(df) == [(1, "Olm", 17.0), (2, "Mouse", 20.0)]


def test_inference_reads_every_row(spark, tmp_path):
    text = "a\n" + "1\n" * 5000 + "x\n"
    assert read_source(spark, write(tmp_path / "a.csv", text)).dtypes == [("a", "string")]


def test_tab_file_with_txt_extension(spark, tmp_path):
    df = read_source(spark, write(tmp_path / "a.txt", "a\tb\n1\tx\n2\ty\n"), delimiter=r"\t")
    assert df.columns == ["a", "b"] and df.count() == 2


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_sniffing(spark, tmp_path, sep):
    text = "\n".join(sep.join(r) for r in (["a", "b", "c"], ["1", '"x,;|y"', "2"], ["3", "z", "4"]))
    path = write(tmp_path / "a.txt", text)
    assert sniff_delimiter(spark, path) == sep
    assert read_source(spark, path).columns == ["a", "b", "c"]


def test_sniffing_one_column_and_nothing(spark, tmp_path):
    assert sniff_delimiter(spark, write(tmp_path / "a.txt", "name\nx\ny\n")) == ","
    assert sniff_delimiter(spark, write(tmp_path / "b.txt", "")) == ","


def test_sniffing_looks_at_every_line(spark, tmp_path):
    text = "a;b,c\n" + "1;2,3\n" * 300 + "1;2\n"
    assert sniff_delimiter(spark, write(tmp_path / "a.txt", text)) == ";"


def test_ragged_lines_end_the_job(spark, tmp_path):
    for name, line in (("long", "1,2,3"), ("short", "4")):
        df = read_source(spark, write(tmp_path / f"{name}.csv", f"a,b\n5,6\n{line}\n"), delimiter=",", schema="a int, b int")
        with pytest.raises(Exception, match="MALFORMED"):
            df.select("a").collect()


def test_a_declared_schema_is_matched_by_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", "b,a\n1,2\n")
    assert rows(read_source(spark, path, schema="a int, b int")) == [(2, 1)]
    with pytest.raises(ValueError, match="header"):
        read_source(spark, path, schema="a int, c int")


def test_only_files_with_broken_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "d.csv").mkdir()
    write(tmp_path / "d.csv" / "one.csv", 'a,b\n1,"x\ny"\n')
    write(tmp_path / "d.csv" / "two.csv", "a,b\n2,z\n")
    assert sorted(r["broken"] for r in text_survey(spark, str(tmp_path / "d.csv"))) == [False, True]
    assert rows(read_source(spark, str(tmp_path / "d.csv"))) == [(1, "x\ny"), (2, "z")]


def test_json_lines_and_arrays_in_one_folder(spark, tmp_path):
    (tmp_path / "d.json").mkdir()
    write(tmp_path / "d.json" / "a b.json", '{"id": 1}\n{"id": 2}\n')
    write(tmp_path / "d.json" / "b.json", '\n [{"id": 3,\n "x": "y"}, {"id": 4}]')
    write(tmp_path / "d.json" / "c.json", '[{"id": 5}]\n[{"id": 6}, {"id": 7}]\n')
    assert rows(read_source(spark, str(tmp_path / "d.json")).select("id", "x")) == [(1, None), (2, None), (3, "y"), (4, None), (5, None), (6, None), (7, None)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_source(spark, write(tmp_path / "bad.json", '{"id": 1}\n{oops\n')).collect()


def test_zipped_json_lines_and_a_declared_parquet_schema(spark, tmp_path):
    path = make_zip(tmp_path / "a.zip", {"rows.ndjson": '{"a": 1, "b": "q"}\n{"a": 2, "b": "r"}\n'})
    assert rows(read_source(spark, path, member="rows.ndjson")) == [(1, "q"), (2, "r")]


def test_repeated_headers_are_numbered(spark, tmp_path):
    assert read_source(spark, write(tmp_path / "a.csv", "a,b,A\n1,2,3\n")).columns == ["a", "b", "A_1"]


def test_names_are_kept_and_empty_fields_are_null(spark, tmp_path):
    df = read_source(spark, write(tmp_path / "a.csv", 'Body mass (g),b\n1,""\n2,\n3,x\n'))
    assert df.columns == ["Body mass (g)", "b"]
    assert [r.b for r in df.collect()] == [None, None, "x"]


def test_values_may_hold_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,"x\ny ""q"", z"\n2,w\n')
    assert rows(read_source(spark, path)) == [(1, 'x\ny "q", z'), (2, "w")]
    assert read_delimited(spark, path, ",", schema="a string, b string", multi_line=False).count() == 3


def test_declared_schema_needs_no_inference(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n")
    assert read_source(spark, path, schema="a string, b int").dtypes == [("a", "string"), ("b", "int")]


def test_json_lines_and_array(spark, tmp_path):
    records = [{"id": 1, "name": "a"}, {"id": 2, "name": None}]
    lines = write(tmp_path / "a.ndjson", "\n".join(json.dumps(r) for r in records))
    array = write(tmp_path / "a.json", json.dumps(records, indent=1))
    for path in (lines, array):
        assert rows(read_source(spark, path)) == [(1, "a"), (2, None)]
    assert read_json(spark, lines, columns=["name", "id"]).columns == ["name", "id"]


def test_missing_file(spark, tmp_path):
    for name in ("a.csv", "a.parquet", "a.json"):
        with pytest.raises(FileNotFoundError):
            read_source(spark, str(tmp_path / name))


def make_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def test_zip_takes_the_first_data_member(spark, tmp_path):
    path = make_zip(tmp_path / "a.zip", {"readme.md": "x", "b.csv": "a\n9\n", "a.csv": "a\n1\n2\n"})
    assert rows(read_source(spark, path)) == [(1,), (2,)]


def test_zip_takes_the_named_member(spark, tmp_path):
    path = make_zip(tmp_path / "a.zip", {"b/c.tsv": "a\tb\n9\t8\n", "a.csv": "a\n1\n"})
    assert rows(read_source(spark, path, member="b/c.tsv")) == [(9, 8)]


def test_zip_without_data(spark, tmp_path):
    with pytest.raises(Exception, match="no data file"):
        read_source(spark, make_zip(tmp_path / "a.zip", {"readme.md": "x"}))


def test_folder_of_zips_is_one_table(spark, tmp_path):
    folder = tmp_path / "all.zip"
    folder.mkdir()
    for i in range(3):
        make_zip(folder / f"{i}.zip", {"data.csv": f"a,b\n{i},x\n"})
    assert rows(read_source(spark, str(folder))) == [(0, "x"), (1, "x"), (2, "x")]


def test_zipped_parquet(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.write(part, "p.parquet")
    assert read_source(spark, str(tmp_path / "p.zip")).count() == 5


def test_landing_twice_gives_one_copy(spark, tmp_path):
    raw = Layers("landed", str(tmp_path / "db")).create(spark).raw
    spec = TableSpec(write(tmp_path / "a.csv", "id,name\n1,Olm\n2,Mouse\n"), "animals")
    assert [land_source(spark, spec, raw) for _ in range(2)] == [2, 2]
    assert spark.table(f"{raw}.animals").count() == 2


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    raw = Layers("failing", str(tmp_path / "db")).create(spark).raw
    save_table(spark.range(3), raw, "t")
    with pytest.raises(Exception):
        save_table(spark.range(3).selectExpr("assert_true(id < 2) AS ok"), raw, "t")
    assert spark.table(f"{raw}.t").count() == 3


def test_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    raw = Layers("selfread", str(tmp_path / "db")).create(spark).raw
    save_table(spark.range(4), raw, "t")
    before = spark.table(f"{raw}.t")
    assert save_table(before.where("id > 0"), raw, "t") == 3
    assert before.count() == 4
    assert remove_old_versions(spark, raw, "t") == 1
    assert spark.table(f"{raw}.t").count() == 3
    assert remove_old_versions(spark, raw, "t") == 0


def test_land_dataset_and_catalog(spark, tmp_path):
    files = {n: write(tmp_path / f"{n}.csv", "id,v\n1,2\n") for n in ("one", "two")}
    dataset = Dataset("cat-1", [TableSpec(p, n) for n, p in files.items()], str(tmp_path / "db"))
    assert land_dataset(spark, dataset) == {"one": 1, "two": 1}
    raw = dataset.layers.raw
    spark.range(1).createOrReplaceTempView("not_in_any_database")
    assert tables_in(spark, raw) == ["one", "two"]
    assert raw in layer_databases(spark)
    assert table_exists(spark, raw, "one") and not table_exists(spark, raw, "three")
    assert rows(list_columns(spark, [raw]))[0] == (raw, "one", 0, "id", "bigint")
    with pytest.raises(ValueError, match="no such table"):
        require_table(spark, raw, "three")


def test_landing_a_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        land_source(spark, TableSpec(str(tmp_path / "no.csv"), "t"), "default")


def test_scratch_paths_are_new(spark):
    assert new_scratch(spark, "a") != new_scratch(spark, "a")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_text_is_cut_into_records_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(4)
    parts = ["a", "é", ",", '"', "\n", "\r\n", " ", "\n\n", "x" * 150, ""]
    records = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) + "!") for i in range(300)]
    folder = tmp_path / "d.csv"
    folder.mkdir()
    for name, own in (("one.csv", records[:299]), ("two.csv", records[299:]), ("none.csv", [])):
        with open(folder / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\r\n" if name == "one.csv" else "\n").writerows([("id", "text"), *own])
    found = read_source(spark, str(folder), delimiter=",")
    assert rows(found) == [(i, t.replace("\r\n", "\n")) for i, t in records]
    declared = read_source(spark, str(folder), delimiter=",", schema="text string, id int")
    assert rows(declared) == sorted((t.replace("\r\n", "\n"), i) for i, t in records)
    # The cutting itself is spread.
    states = records_module.starting_states(_survey(spark, str(folder)).selectExpr("file_path", "start", "quotes AS flips", "0 AS outside", "0 AS inside"), "s")
    cut = records_module.records(records_module.units(spark, str(folder), records_module.CSV), states, records_module.CSV)
    assert cut.count() == 303 and cut.where("first").count() == 3
    assert states.where("quoted").count() > 2 and len(cut.select(F.spark_partition_id()).distinct().collect()) > 10


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_are_cut_into_objects_by_many_tasks(spark, tmp_path, small_splits, indent):
    rng = random.Random(7)
    parts = ["a", "é", ",", '"', "\n", "\\", "{", "}", "[", "]", "\\u0041", "x" * 120]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
    data = [{"id": i, "text": text(), "inner": {"list": [{"v": text()}, {"v": i}][: i % 3]}} for i in range(200)]
    folder = tmp_path / "d.json"
    folder.mkdir()
    (folder / "array.json").write_text(" \n" + json.dumps(data[:150], indent=indent, ensure_ascii=False) + "\n")
    (folder / "objects.json").write_text("\n".join(json.dumps(d, indent=indent) for d in data[150:199]))
    (folder / "lines of arrays.json").write_text(json.dumps(data[199:], indent=indent) + "\n[]\n")
    (folder / "empty.json").write_text("")
    found = read_json(spark, str(folder))
    assert [(r["id"], r["text"]) for r in found.orderBy("id").collect()] == [(d["id"], d["text"]) for d in data]
    inner = [[str(x["v"]) for x in d["inner"]["list"]] for d in data]
    assert [[x["v"] for x in r["inner"]["list"]] for r in found.orderBy("id").collect()] == inner
    text = records_module.units(spark, str(folder), records_module.JSON)
    states = records_module.starting_states(records_module.json_changes(text), "s")
    cut = records_module.records(text, states, records_module.JSON)
    assert cut.count() == 200 and len(cut.select(F.spark_partition_id()).distinct().collect()) > 10


def test_files_that_end_inside_a_record_end_the_job(spark, tmp_path):
    with pytest.raises(ValueError, match="MALFORMED"):
        read_source(spark, write(tmp_path / "a.csv", 'a,b\n1,"x\ny\n'))
    with pytest.raises(ValueError, match="MALFORMED"):
        read_source(spark, write(tmp_path / "a.json", '[{"a": 1},\n{"a": '))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_source(spark, write(tmp_path / "b.json", '[{"a": 1}, oops, {"a": 2}]'), schema="a int").collect()


def test_values_of_a_folder_meet_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "d.csv"
    folder.mkdir()
    write(folder / "a.csv", "a,b\n1,2\n")
    write(folder / "b.csv", "\ufeffb,a\n3,4\n")
    found = read_source(spark, str(folder))
    assert found.dtypes == [("a", "bigint"), ("b", "bigint")] and rows(found) == [(1, 2), (4, 3)]
    assert rows(read_source(spark, str(folder), schema="b int, a int")) == [(2, 1), (3, 4)]
    write(folder / "c.csv", 'a,c\n5,"x\ny"\n')
    write(folder / "d.csv", "b,a\n1.5,6\n")
    found = read_source(spark, str(folder))
    assert dict(found.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert rows(found.select("a", "b", "c")) == [(1, 2.0, None), (4, 3.0, None), (5, None, "x\ny"), (6, 1.5, None)]
    with pytest.raises(ValueError, match="header"):
        read_source(spark, str(folder), schema="a int, b int")


def test_heads_tell_lines_from_other_json(tmp_path):
    heads = {'{"a": 1}\n{': True, "": True, '{"a":\n1}': False, "[1]": False, '\n {"a": {"b": 2}}': True, "{oops}\n": True}
    for i, (text, lines) in enumerate(heads.items()):
        assert records_module._starts_with_object(write(tmp_path / f"{i}.json", text)) is lines
    assert not records_module._starts_with_object("viewfs://store/a.json")


def test_an_array_is_written_a_batch_at_a_time():
    frames = [pd.DataFrame({"value": []}, dtype=object), pd.DataFrame({"value": ['{"a": 1}', "{}"]}), pd.DataFrame({"value": ['{"b": 2}'] * 500})]
    found = list(_as_array(iter(frames)))
    assert [len(f) for f in found] == [2, 500, 1]
    assert json.loads("\n".join(v for f in found for v in f["value"])) == [{"a": 1}, {}, *[{"b": 2}] * 500]
    assert [list(f["value"]) for f in _as_array(iter(frames[:1]))] == [["[]"]]
