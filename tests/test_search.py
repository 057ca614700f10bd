"""Searches through postings give what a scan gives."""

import pytest

from matchlens.operators import reports, search

NAMES = ["Ann Ana", "ANNA", "Bo", "", None, "José Peña", "aaaa", "Ana Ann", "x" * 500 + "ann"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(NAMES * 2)], "player_id long, player_name string, season int")
    path = str(tmp_path_factory.mktemp("search") / "postings")
    search.write_postings(rows, path, "player_id")
    return rows, path


@pytest.mark.parametrize("term", ["ann", "ANN", "na an", "peña", "aaa", "aaaaa", "bo", "zzz", "", None, "x" * 400])
def test_equal_to_contains(spark, stored, term):
    rows, path = stored
    got = search.search_postings(spark, rows, path, term, "player_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, reports.search_players(rows, term).collect()))


def test_grams_reach_the_scan(spark, stored, capsys):
    rows, path = stored
    search.search_postings(spark, rows, path, "anna", "player_id").explain("formatted")
    assert "In(gram, [ann,nna])" in capsys.readouterr().out
