"""The golden fixture: 21 named entities plus a NULL-entity group.

Rows and expected values are the ones designed in FIXTURES.md (sections 2-3).
"""

import datetime as dt

from pyspark.sql import types as T

ROWS_TEXT = """
P01 A 2020-01-01 op 0
P01 A 2020-02-01 ae 1
P02 A 2020-01-01 op 0
P02 B 2020-02-01 op 0
P02 B 2020-03-01 op 0
P03 A 2020-01-01 op 0
P03 A 2020-02-01 op 0
P03 B 2020-03-01 op 0
P04 A 2020-01-01 op 0
P04 B 2020-02-01 op 0
P05 A 2020-03-01 apc 0
P05 B 2020-03-01 op 1
P06 A 2020-01-01 op 0
P06 Z 2020-02-01 op 0
P06 Z 2020-03-01 op 0
P06 99 2020-04-01 op 0
P07 S 2020-02-01 op 0
P07 S 2020-03-01 op 0
P07 A 2020-01-01 op 0
P08 S 2020-01-01 op 0
P08 Z 2020-02-01 op 0
P08 Z 2020-03-01 op 0
P09 Z 2020-01-01 op 0
P09 99 2020-02-01 op 0
P10 Z 2020-01-01 op 0
P10 Z 2020-02-01 op 0
P11 A 2020-01-01 apc 1
P11 B 2020-03-01 other 1
P12 A 2020-01-01 op 1
P12 B 2020-03-01 op -
P13 A - op 0
P13 B 2020-01-01 op 0
P14 A - op 0
P15 A 2020-01-01 op 0
P15 - 2020-02-01 op 0
P16 - 2020-01-01 op 0
P16 Z 2020-02-01 op 0
P17 historic 2020-01-01 op 0
P18 J 2020-03-01 op 0
P18 U 2020-03-01 op 0
P19 A 2020-03-01 op 1
P19 A 2020-03-01 op 1
P19 B 2020-01-01 op 1
P20 A 2020-03-01 op 0
P20 B 2020-03-01 ae 0
P20 B 2020-03-01 ae 0
P21 A 2020-03-01 apc 1
P21 B 2020-03-01 apc 1
-   A 2020-01-01 op 0
-   B 2020-02-01 op 0
"""

SCHEMA = T.StructType(
    [
        T.StructField("rid", T.IntegerType()),
        T.StructField("entity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("observed_at", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("flag", T.IntegerType()),
    ]
)


def _v(x):
    return None if x == "-" else x


def rows():
    out = []
    for i, line in enumerate(l for l in ROWS_TEXT.strip().splitlines()):
        e, c, d, s, f = line.split()
        out.append(
            (
                i,
                _v(e),
                _v(c),
                None if d == "-" else dt.date.fromisoformat(d),
                _v(s),
                None if f == "-" else int(f),
            )
        )
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


U = "unresolved"
ABSENT = "absent"
NULL = None
# Columns: A2 modal, A3 NONE, A3 SOURCE, A3 FLAG, A4 modal, A5 NONE, A5 SOURCE, A5 FLAG.
# A value "X*n" means n records (the flag rule keeps same-day repeats).
EXPECTED = {
    "P01": ["A", "A", "A", "A", "A", "A", "A", "A"],
    "P02": ["B", "B", "B", "B", "B", "B", "B", "B"],
    "P03": ["A", "B", "B", "B", "A", "B", "B", "B"],
    "P04": [U, "B", "B", "B", U, "B", "B", "B"],
    "P05": [U, U, "A", "B", U, U, "A", "B"],
    "P06": ["A", "A", "A", "A", "Z", "99", "99", "99"],
    "P07": ["A", "A", "A", "A", "S", "S", "S", "S"],
    "P08": ["S", "S", "S", "S", "Z", "Z", "Z", "Z"],
    "P09": [U, "99", "99", "99", U, "99", "99", "99"],
    "P10": ["Z", "Z", "Z", "Z", "Z", "Z", "Z", "Z"],
    "P11": [U, "B", "A", "B", U, "B", ABSENT, "B"],
    "P12": [U, "B", "B", ABSENT, U, "B", "B", ABSENT],
    "P13": [U, "B", "B", "B", U, "B", "B", "B"],
    "P14": ["A", ABSENT, ABSENT, ABSENT, "A", ABSENT, ABSENT, ABSENT],
    "P15": ["A", NULL, NULL, NULL, "A", ABSENT, ABSENT, ABSENT],
    "P16": [NULL, NULL, NULL, NULL, "Z", "Z", "Z", "Z"],
    "P17": ["historic"] * 8,
    "P18": [U, U, U, U + "*2", U, U, U, U + "*2"],
    "P19": ["A", "A", "A", "A*2", "A", "A", "A", "A*2"],
    "P20": ["B", U, "B", U + "*3", "B", U, "B", U + "*3"],
    "P21": [U, U, U, U + "*2", U, U, U, U + "*2"],
    None: [U, "B", "B", "B", U, "B", "B", "B"],
}
COLUMNS = ["A2", "A3_NONE", "A3_SOURCE", "A3_FLAG", "A4", "A5_NONE", "A5_SOURCE", "A5_FLAG"]


def expected(column):
    i = COLUMNS.index(column)
    return {e: vals[i] for e, vals in EXPECTED.items()}
