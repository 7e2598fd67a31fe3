"""Tables that change together: writers that die at any step lose nothing, and conflicts show."""

import os

import pytest

from skein.operators import store


class Killed(BaseException):
    pass


@pytest.fixture
def tables(spark, tmp_path):
    t = store.Tables(spark, f"file://{tmp_path}/db", {"parts": "book"})
    t.commit(append={"a": spark.createDataFrame([(1,), (2,)], "k int")}, replace={"b": spark.createDataFrame([("x",)], "v string")})
    return t


def held(tables, name, version=None):
    return sorted(tuple(r) for r in tables.read(name, version).collect())


def test_commit_is_seen_whole(spark, tables):
    tables.commit(append={"a": spark.createDataFrame([(3,)], "k int")}, replace={"b": spark.createDataFrame([("y",)], "v string")})
    assert held(tables, "a") == [(1,), (2,), (3,)] and held(tables, "b") == [("y",)]
    assert held(tables, "a", 1) == [(1,), (2,)] and held(tables, "b", 1) == [("x",)]
    assert tables.has("b") and not tables.has("c") and tables.get("c", "z int").count() == 0
    with pytest.raises(LookupError):
        tables.read("c")


@pytest.mark.parametrize("step", ["data", "document", "link"])
def test_killed_writers(spark, tables, tmp_path, monkeypatch, step):
    """The writer dies after its data, inside its document, or before the document gets its number."""
    more = spark.createDataFrame([(3,)], "k int")

    def die(*_, **__):
        raise Killed

    def half(self, number, document):
        (tmp_path / "db/commits/.half").write_text('{"tables"')
        raise Killed

    with monkeypatch.context() as m:
        if step == "data":
            m.setattr(store.Log, "publish", die)
        elif step == "document":
            m.setattr(store.Log, "publish", half)
        else:
            m.setattr(os, "link", die)
        with pytest.raises(Killed):
            tables.commit(append={"a": more}, replace={"b": spark.createDataFrame([("lost",)], "v string")})
    assert tables.versions() == [1] and held(tables, "a") == [(1,), (2,)] and held(tables, "b") == [("x",)]
    tables.commit(append={"a": more})
    assert held(tables, "a") == [(1,), (2,), (3,)]
    assert len(tables.vacuum(keep=9, older=0)) == 2 and held(tables, "a") == [(1,), (2,), (3,)]  # what nothing names goes


@pytest.mark.parametrize("damage", ["", "{\"tables\": {\"a\"", "[]"])
def test_damaged_versions_are_skipped(spark, tables, tmp_path, damage):
    (tmp_path / "db/commits/000000000002").write_text(damage)
    (tmp_path / "db/commits/notes.txt").write_text("no version")
    assert tables.version() == 1 and held(tables, "a") == [(1,), (2,)]
    assert tables.commit(append={"a": spark.createDataFrame([(3,)], "k int")}) == 3
    assert tables.versions() == [1, 3] and held(tables, "a") == [(1,), (2,), (3,)]


def test_writers_that_meet(spark, tables):
    """Appends and other tables go on top of what came between; tables that were replaced or read don't."""
    one = lambda k: spark.createDataFrame([(k,)], "k int")
    base = tables.version()
    tables.commit(append={"a": one(3)})
    tables.commit(append={"a": one(4)}, at=base)
    tables.commit(replace={"b": spark.createDataFrame([("z",)], "v string")}, at=base)
    assert held(tables, "a") == [(1,), (2,), (3,), (4,)] and held(tables, "b") == [("z",)]
    for how in ({"replace": {"a": one(9)}}, {"append": {"c": one(9)}, "reads": ["a"]}):
        with pytest.raises(store.Conflict):
            tables.commit(**how, at=base)
    assert held(tables, "a") == [(1,), (2,), (3,), (4,)] and not tables.has("c")


def test_number_taken_meanwhile(spark, tables, monkeypatch):
    """The number is taken between the look at it and the publication."""
    publish, raced = store.Log.publish, []

    def late(self, number, document):
        if not raced:
            raced.append(number)
            publish(self, number, {"tables": tables.state()})
        publish(self, number, document)

    monkeypatch.setattr(store.Log, "publish", late)
    assert tables.commit(append={"a": spark.createDataFrame([(3,)], "k int")}) == 3 and raced == [2]
    assert held(tables, "a") == [(1,), (2,), (3,)]


def test_partitions_are_swapped(spark, tables):
    rows = lambda *x: spark.createDataFrame(x, "k int, book string")
    tables.commit(replace={"parts": rows((1, "007"), (2, "b"), (3, None))})
    first = set(tables.state()["parts"]["entries"])
    tables.commit(swap={"parts": rows((9, "b"), (8, "c d/e"))})
    assert sorted(held(tables, "parts"), key=str) == [(1, "007"), (3, None), (8, "c d/e"), (9, "b")]
    assert len(first & set(tables.state()["parts"]["entries"])) == 2  # files of the others stay
    tables.commit(append={"parts": spark.createDataFrame([(5, "b", 1.5)], "k int, book string, more double")})
    assert sorted(held(tables, "parts"), key=str)[-1] == (9, "b", None) and tables.read("parts").where("more > 1").count() == 1
    tables.commit(replace={"parts": tables.read("parts").limit(0)})
    assert tables.has("parts") and tables.read("parts").count() == 0
