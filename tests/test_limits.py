"""Queries held against their SQL on rows whose values lie on a limit."""

import duckdb
import pytest

from skyfix.plans import registry

from test_oracle import rows

SF = "/root/testdata/sf0.1"


@pytest.fixture
def cut(tmp_path):
    """A folder with some rows of the tables, and DuckDB's views of them."""

    def make(**tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for name, sql in tables.items():
            con.execute(f"create view {name} as {sql}")
            con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
        return str(tmp_path), con

    return make


def agree(spark, name, made):
    folder, con = made
    found = rows(registry.QUERIES[name](spark, folder).toPandas())
    assert found == rows(con.execute(registry.SQL[name]).df())
    return found


def test_box_at_exactly_twelve_metres(spark, cut):
    """Session 30: a box of witness 244 is 12 m away to the last digit."""
    made = cut(supplier=f"select * from '{SF}/supplier.parquet' where s_suppkey between 240 and 247", part=f"select * from '{SF}/part.parquet' where p_partkey between 4800 and 4959")
    assert any("244" in r for r in agree(spark, "building_boxes_peak", made))


def test_azimuth_a_hair_west_of_north(spark, cut):
    """Tilt angles that look level, and north but for the last digit."""
    orders = "select 59830 + 3660 * i + j AS o_orderkey, c AS o_custkey from range(0, 60) a(i), range(0, 2) b(j), range(0, 360) d(c)"
    found = agree(spark, "handheld_pose", cut(orders=orders))
    assert any("360" in r for r in found)


def test_photos_with_few_bright_stars(spark, cut):
    """Of the seven brightest dots of 139, 304 and 753 one is among the 120 brightest stars of its sky, so that no pair
    of them says anything: they had no pose, or a wrong one."""
    photos = (139, 304, 753)
    skies = tuple(p // 20 for p in photos)
    made = cut(supplier=f"select * from '{SF}/supplier.parquet' where s_suppkey in {photos}", part=f"select * from '{SF}/part.parquet' where p_partkey // 400 in {skies}")
    assert len(agree(spark, "star_plate_solve", made)) == 3


def test_photos_with_pairs_far_off(spark, cut):
    """Photos 22213 and 49837: a dot that is no star pairs with a star near the picture's edge and bends the fit."""
    supplier = "select unnest([22213, 49837]) AS s_suppkey"
    part = "select i AS p_partkey from range(444000, 444400) a(i) union all select i from range(996400, 996800) b(i)"
    assert len(agree(spark, "star_plate_solve", cut(supplier=supplier, part=part))) == 2
