from tidemark.operators import registers


def test_the_first_key_that_is_known_decides(spark):
    entries = [
        (1, 1, "M/V Árta-1", "AB 12", "Linked; MMSI 123456789; mmsi  223456789 (IMO 7654321)"), (2, 2, "Bora", "0", "IMO 12345678 MMSI 12345678"), (3, 3, "b.o.r.a", None, None), (3, 4, "Repeat", "ZZ", None), (None, 5, "Nobody", "YY", None),
        (4, 6, "  ", "--", "IMO 7654321"),
    ]
    rows = [(1, 123456789, None, "zz", "bora"), (2, 223456789, 7654321, None, None), (3, 5, 7654321, "AB12", None), (4, 5, None, "a-b 12", "BORA"), (5, 5, None, "0", "Bo Ra"), (6, None, None, "ZZ", "repeat"), (7, 12345678, 1234567, "", "nobody"), (8, None, None, None, "MV ÁRTA 1")]
    out = registers.listed(spark.createDataFrame(rows, "row_id int, mmsi long, imo long, call_sign string, name string"), spark.createDataFrame(entries, "match_id int, ord int, name string, call_sign string, remarks string"))
    got = {r["row_id"]: (r["match_id"], r["basis"]) for r in out.collect()}
    assert got == {1: (1, "mmsi"), 2: (1, "mmsi"), 3: (4, "imo"), 4: (1, "call_sign"), 5: (3, "name"), 6: (None, None), 7: (None, None), 8: (1, "name")}
