from geocell.functions import polygon as P
from geocell.operators import skew
from geocell.plans import router


def test_relations_of_known_cells():
    cells = {c: r for c, r in P.cover(P.BOX_US, 2)}
    assert cells == {c: 1 for c in ("9w", "9x", "9y", "9z")}
    assert P.relation(P.TRIANGLE, "9xn") == P.ENCLOSED
    continent = P.cover(P.CONTINENT, 2)
    assert [c for c, r in continent if r == 0] == sorted("9r 9w 9x 9z c2 c3 c8 c9 cb f0".split())
    assert sum(r == 1 for _, r in continent) == 27


def test_decode():
    assert [float(x) for x in P.decode("9x")] == [39.375, 45.0, -112.5, -101.25]


def test_split_keeps_every_row(spark):
    cells = router.base_map(spark)
    more = router.split(cells, ["9x"])
    assert more.count() == 2047 and more.agg({"part": "max"}).first()[0] == 2047
    assert [P.relation(P.BOX_US, r.prefix) for r in more.where("length(prefix) = 4").collect()].count(0) == 780


def test_to_move():
    assert skew.to_move({1: 10, 2: 20}) == []  # too few to matter
    # goal 6066: 5000 is moved, 1066 are left, the right neighbour follows, then less than 1000 are left
    assert skew.to_move({1: 2000, 2: 5000, 3: 2000, 4: 100}) == [2, 3]
