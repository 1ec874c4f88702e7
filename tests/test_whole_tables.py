"""Queries that read all of their tables; their values are held against SQL in test_queries."""

import os

import pytest
from test_queries import SF

from lotledger.operators import library
from lotledger.plans import registry
from lotledger.plans.derive import table

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")



def test_reviewed_cars_are_added_and_in_conflict(spark):
    got = [r["result"] for r in registry.QUERIES["publish_new"](spark, SF).select("result").collect()]
    assert 0 < got.count("added") < got.count("conflict") and len(got) == table(spark, SF, "lineitem").count()


def test_every_reply_gets_a_row(spark):
    got = [r["event_id"] for r in registry.QUERIES["reply_shape"](spark, SF).collect()]
    assert sorted(got) == sorted(r["event_id"] for r in table(spark, SF, "sheet_replies").select("event_id").collect())


def test_status_of_every_car_comes_from_its_location(spark):
    status = {r["car"]: r for r in registry.QUERIES["car_status"](spark, SF).collect()}
    located = registry.QUERIES["locate"](spark, SF).collect()
    assert set(status) == {f"car{r['car_id']}" for r in located} and len(status) == len(located)
    files = [(r["path"], r["name"].lower()) for r in table(spark, SF, "library_entries").collect()]
    photo = tuple(library.IMAGE_SUFFIXES)
    n_matched = 0
    for r in located:
        s = status[f"car{r['car_id']}"]
        assert s["folder_path"] == (r["variant_path"] if r["outcome"] == "matched" else None)
        below = [n for p, n in files if s["folder_path"] and p.startswith(s["folder_path"] + "/")]
        assert s["n_pdfs"] == sum(n.endswith(".pdf") for n in below) and s["n_photos"] == sum(n.endswith(photo) for n in below)
        assert s["status"] == ("needs_review" if r["outcome"] == "blocked" else "ok" if s["n_pdfs"] else "needs_folder_link")
        n_matched += s["folder_path"] is not None
    assert 0 < n_matched < len(located)
