import pytest

from trekmill.operators import addresses

STREETS = [(1, "Via Roma", "A"), (2, "Via Romagna", "B"), (3, "Largo via Romà", "C"), (4, "Roma", "D"), (5, "Via Roma", "E"), (6, None, "F"), (7, "Aroma", "G")]
ADDRESSES = [(11, 1, "5", 10.0, 10.0), (10, 1, "12B", 11.0, 11.0), (9, 1, "12b", 12.0, 12.0), (20, 2, "12b", 1.0, 1.0), (30, 3, "1", 0.0, 0.0), (31, 3, "2", 0.0, 9.0), (32, 3, "3", 9.0, 9.0), (40, 4, None, 5.0, 5.0)]


@pytest.fixture(scope="module")
def found(spark):
    s = spark.createDataFrame(STREETS, "street_id long, name string, city string")
    a = spark.createDataFrame(ADDRESSES, "address_id long, street_id long, number string, lat double, lon double")
    return lambda text, limit=20: [(r.street_id, r.number, r.lat) for r in addresses.search(s, a, text, limit).orderBy("place").collect()]


def test_numbers(found):
    assert found("via roma 12b") == [(1, "12b", 12.0), (2, "12b", 1.0)]  # the least address of a street, case aside
    assert found("12B Via Roma") == found("via roma 12b") and found("via roma 12b", 1) == [(1, "12b", 12.0)]
    assert found("via roma 99") == []


def test_streets(found):
    # the start of the name first, by key and id, then words; a street without addresses gives no result
    assert [s for s, *_ in found("roma")] == [4, 3, 1, 2]
    assert found("Romà") == found("roma") and found("via roma")[0] == (1, None, 11.0)
    assert found("largo") == [(3, None, 0.0)]  # the upper medians are 0 and 9
    assert found(" ?! ") == [] and found("zzz") == []
