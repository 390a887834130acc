"""Queries against their SQL on rows whose names differ in nothing but sharp s and ss, and on pages with titles cut within an escape."""

import os

import duckdb
import pytest

from recordloom.plans import registry
from tests.oracle import TABLES, differences

#: Names that are equal once sharp s is spelled out, and one that is equal in lower case.
TURNS = ["Beßü SSü Bessü\nTarn BESSü", "Bessü, Beßü, SSü, TARN\nTarn Beßü"]
ROWS = {
    "conversations": [(k, turn, role, TURNS[(k + turn) % 2]) for k in range(4) for turn, role in enumerate(["system", "user"])],
    "documents": [(1, "SSü, Beßü, Tarn\nTarn, Bessü"), (2, "Bessü is a page"), (3, "ßü is another, Tarn, SSü"), (4, "tarn too"), (5, "Tarn")],
    "pages": [(k, f"http://h.example/{k}", f"<title>a &amp;&amp; b{end}</title><p>x &quot;y&quot; z</p>") for k, end in enumerate(["&", "&a", "&am", "&amp", "&amp;", "&quo", "&quot", "&quot;", "&lt", "&gt", "&amp x", "&ampx", "&amp;amp"])],
    "benchmark": [(1, "ßü stands here. Bessü too, tarn as well")],
}
COLUMNS = {"conversations": "conv_id bigint, turn bigint, role varchar, text varchar", "documents": "doc_id bigint, text varchar", "pages": "page_id bigint, url varchar, html varchar", "benchmark": "item_id bigint, text varchar"}


@pytest.fixture(scope="module")
def sharp(tmp_path_factory, small):
    folder = tmp_path_factory.mktemp("sharp")
    con = duckdb.connect()
    for t in TABLES:
        if t in ROWS:
            con.execute(f"create table {t} ({COLUMNS[t]})")
            con.executemany(f"insert into {t} values ({', '.join('?' * len(ROWS[t][0]))})", ROWS[t])
            con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{small}/{t}.parquet", folder / f"{t}.parquet")
    return str(folder)


def same(spark, sharp, name):
    assert differences(spark, name, registry.QUERIES[name], registry.SQL[name], sharp) is None


def test_pages_of_mentions(spark, sharp):
    same(spark, sharp, "i7_mention_detail")


def test_titles_cut_within_an_escape(spark, sharp):
    same(spark, sharp, "t2_page_text")


def test_summary_of_mentions(spark, sharp):
    same(spark, sharp, "g10_summary")


def test_headed_names(spark, sharp):
    same(spark, sharp, "g2_headed_names")


def test_comma_names(spark, sharp):
    same(spark, sharp, "g3_comma_names")


def test_mentions(spark, sharp):
    same(spark, sharp, "g9_mentions")


def test_rollup_of_mentions(spark, sharp):
    same(spark, sharp, "h10_mentions")
