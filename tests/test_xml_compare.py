"""Node differences of XML documents."""

from docledger.sources.xml_compare import xml_differences

LEFT = [
    (1, "<a><b>1</b><b>2</b></a>"),
    (2, '<n:a xmlns:n="u"><n:b k="1"> x </n:b><c><d><e>1</e></d></c></n:a>'),
    (3, "<a>broken"),
    (4, "<a/>"),
    (5, None),
    (6, "<a>\n  <b>1</b>\n</a>"),
    (None, "<a/>"),
]
RIGHT = [
    (1, "<a><b>1</b><b>3</b><b>4</b></a>"),
    (2, '<a><b k="2">x</b></a>'),
    (3, "<a>worse"),
    (5, "<a/>"),
    (6, "<a><b>1</b></a>"),
    (None, "<b/>"),
]


def test_differences(spark):
    schema = "k long, x string"
    found = xml_differences(spark.createDataFrame(LEFT, schema), spark.createDataFrame(RIGHT, schema), "k", "x")
    assert sorted(map(tuple, found.collect())) == [
        (1, "/a/b[2]", "changed", "2", "3"),
        (1, "/a/b[3]", "only_right", None, "4"),
        (2, "/a/b[1]", "changed", "x @k=1", "x @k=2"),
        (2, "/a/c[1]", "only_left", "", None),
        (3, "?", "changed", "<a>broken", "<a>worse"),
        (4, "/", "only_left", None, None),
        (5, "/", "only_right", None, None),
    ]


def test_nothing_to_compare(spark):
    same = spark.createDataFrame(LEFT, "k long, x string").where("k is not null")
    assert xml_differences(same, same, "k", "x").count() == 0
    assert xml_differences(same.limit(0), same.limit(0), "k", "x").count() == 0
