import hashlib

import pytest
from pyspark.sql import functions as F

from voltaic.llm import queries
from voltaic.llm import warc_fixity as w


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


BASE = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(2500)]


def test_finds_exactly_what_differs(spark):
    other = [r for r in BASE if r[0] not in (5, 1999)]
    other[100] = (other[100][0], other[100][1], "changed")
    other += [(9_000, "http://new/", "x"), (-3, "http://neg/", "y")]
    got = {(r.file, r.place): r.kind for r in w.audit(pages_of(spark, BASE), pages_of(spark, other)).collect()}
    assert got == {(0, 5): "missing", (1, 999): "missing", (0, 101): "changed", (9, 0): "extra", (-1, 997): "extra"}


def test_equal_replicas_and_order(spark):
    a = pages_of(spark, BASE[:300])
    assert w.audit(a, a.repartition(7)).count() == 0
    assert w.audit(a.limit(0), a.limit(0)).count() == 0
    assert w.audit(a, a.limit(0)).count() == 300


def test_roots_match_brute_force(spark):
    rows = BASE[:137]
    level = {}
    for i, url, html in rows:
        body = html.encode()
        record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n" % (i, url.encode(), len(body)) + body + b"\r\n\r\n"
        level[i] = hashlib.sha256(f"{len(record)}:{hashlib.sha256(record).hexdigest()}".encode()).hexdigest()
    for _ in range(w.LEVELS):
        up = {}
        for k in sorted(level):
            up.setdefault(k // w.FANOUT, []).append(f"{k}={level[k]}")
        level = {k: hashlib.sha256(";".join(v).encode()).hexdigest() for k, v in up.items()}
    root = w.tree(w.records(pages_of(spark, rows)))[-1].first()
    assert (root.file, root.node, root.hash, root.start) == (0, 0, level[0], 0)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "x"), (None, None, None), (2, "é", "日本")]
    a = pages_of(spark, rows).selectExpr("*", "1 as hash", "2 as length")
    assert w.audit(a, a).count() == 0
    fewer = w.audit(a, a.dropDuplicates()).collect()
    assert [(r.file, r.place, r.kind) for r in fewer] == [(0, 1, "changed")]
    assert w.audit(a, a.where("page_id is not null")).count() == 2


def test_records_of_one_place(spark):
    """Equal records count, whatever stands beside them; order does not."""

    def one(*htmls):
        return pages_of(spark, [(7, "u", h) for h in htmls])

    a = one("a", "m", "m", "z")
    assert w.audit(a, one("z", "m", "a", "m")).count() == 0
    for other in (("a", "k", "k", "z"), ("a", "m", "k", "z"), ("a", "m", "z"), ("a", "m", "m", "m", "z"), ("a", "a", "z", "z")):
        assert [(r.place, r.kind) for r in w.audit(a, one(*other)).collect()] == [(7, "changed")]


def test_any_long_and_null_have_places_of_their_own(spark):
    ids = [-(2**63), -(2**63) + 999, -1000, -999, -16_000, -3, -1, 0, 999, 1000, 2**53 + 1, 2**63 - 1]
    found = w.records(pages_of(spark, [(i, "u", "x") for i in ids] + [(None, f"http://n/{i}", "x") for i in range(50)]))
    got = found.select("file", "place", w.page_id(F.col("file"), F.col("place")).alias("page_id")).collect()
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(ids) and sum(r.page_id is None for r in got) == 50
    assert all(r.file == r.page_id // 1000 and r.place == r.page_id % 1000 for r in got if r.page_id is not None)
    lost = [r.page_id for r in w.query(spark, pages_of(spark, [(None, "u", "x"), (9, "u", "x"), (2**63 - 1, "u", "x")])).collect()]
    assert lost == [9]


def test_query_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op7_warc_fixity"]).project("page_id, kind, start, \"end\", other_start, other_end, file, place").fetchall())
    got = sorted(tuple(r[c] for c in ("page_id", "kind", "start", "end", "other_start", "other_end", "file", "place")) for r in queries.queries()["op7_warc_fixity"](spark, "/root/testdata/sf0.001").collect())
    assert got == want and want
