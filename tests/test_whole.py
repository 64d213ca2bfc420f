"""Queries that read whole texts and pages, against counts by hand."""

import os

import pytest

from voltlake.plans import catalogue

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def rows(spark, name):
    return catalogue.queries()[name](spark, FOLDER).collect()


def test_every_link_has_a_row(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = rows(spark, "label_near")
    assert len(got) == sum(r["html"].count('href="') for r in pages if r["html"]) > len(pages)
    assert len({(r["page_id"], r["pos"]) for r in got}) == len(got)


@pytest.mark.parametrize("name", ["script_ratio", "translit", "clean_split"])
def test_texts_are_read(spark, name):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").distinct().count()
    kinds = {tuple(r)[1] for r in rows(spark, name)}
    assert len(kinds) > texts // 2 > 20
