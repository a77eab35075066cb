"""Catalogue files: aliases, comments, blanks, target lists, and the way back."""

import pytest

from tidewatch.sources import catalogues as C

COLUMNS = {"toi": ("string", ["TOI number"]), "period": ("double", ["Period (days)", "orbital_period"]), "disposition": ("string", ["TFOPWG Disposition"])}


@pytest.fixture
def put(tmp_path):
    def write(text, name="a.csv"):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return write


def test_columns_are_found_under_any_of_their_names(spark, put):
    path = put('# made by hand\nTOI Number,PERIOD (days),orbital_period,Comments\n1.01,3.5,9,"a, b"\n2.01,0,,\n3.01,,7.25,\n4.01,x,nan,\n')
    got = C.read_catalogue(spark, path, COLUMNS, ("period",)).orderBy("toi").collect()
    assert [tuple(r) for r in got] == [("1.01", 3.5, None), ("2.01", None, None), ("3.01", 7.25, None), ("4.01", None, None)]


def test_cells_with_commas_and_an_empty_file(spark, put):
    both = {"toi": ("string", ["TOI number"]), "comment": ("string", ["Comments"])}
    assert C.read_catalogue(spark, put('toi,comments\n1,"on, off"\n'), both).collect()[0].comment == "on, off"
    assert C.read_catalogue(spark, put("toi,comments\n", "b.csv"), both).count() == 0


@pytest.mark.parametrize("text", ["# list\n12\nTIC 7\n\ntic0012\nx\n", "name,TIC ID,mag\n'a',12,9\nb,TIC 7,8\nc,12,7\nd,?,6\n"])
def test_target_lists_keep_their_order_and_name_each_star_once(spark, put, text):
    got = C.read_targets(spark, put(text)).orderBy("place").collect()
    assert [r.target_id for r in got] == ["TIC 12", "TIC 7"]


def test_target_list_of_comments_only(spark, put):
    assert C.read_targets(spark, put("# nothing\n")).count() == 0


def test_exclusion_splits_targets(spark):
    t, e = (spark.createDataFrame([(x,) for x in ids], "target_id string") for ids in (["a", "b", "c"], ["b", "b", "z", None]))
    kept, dropped = C.kept_and_dropped(t, e)
    assert {r.target_id for r in kept.collect()} == {"a", "c"} and [r.target_id for r in dropped.collect()] == ["b"]
    assert {r.target_id for r in C.missing(e, t).collect()} == {"z", None}


def test_catalogues_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1 / 3, None, None), ("a", float("nan"), 'x, "y"', None), ("c", 1e-9, "", None)], "target_id string, period double, note string, fit double")
    rows = rows.select(*C.columns_with_values(rows, ["note", "fit"]))
    assert rows.columns == ["target_id", "period", "note"]
    C.write_catalogue(rows, path := f"file://{tmp_path}/out", ["target_id"])
    back = C.read_catalogue(spark, path, {"target_id": ("string", []), "period": ("double", []), "note": ("string", [])}).orderBy("target_id").collect()
    assert [r.target_id for r in back] == ["a", "b", "c"]
    assert back[0].period is None and back[1].period == pytest.approx(1 / 3, rel=1e-9) and back[2].period == 1e-9
    assert back[1].note is None and back[2].note is None
