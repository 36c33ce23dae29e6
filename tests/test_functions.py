import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger.functions import keys as K
from docledger.functions import money as M
from docledger.functions import text as X
from docledger.functions.dates import to_iso_date


def test_normalize_line(column):
    raw = ["  a\t\tb ", "x\x00y", "\xa0p 　q\x1f", "plain text", " ", "ä  ö"]
    assert column(raw, X.normalize_line) == ["a b", "x-y", "p q", "plain text", "", "ä ö"]


def test_clean_lines(column):
    text = "\n --- page 1 ---\n\n  Page 1 of 2\r\nA  b\x0bc\x0c\x1cd\x85e f  \n g\n page x "
    lines = column([text, "", "   \n\t\n", "one"], X.clean_line_array)
    assert lines == [["A b", "c", "d", "e", "f", "g", "page x"], [], [], ["one"]]
    assert column(["Synthetic test invoice 7\nkept"], X.clean_line_array) == [["kept"]]


def test_clean_lines_agree_with_python(column):
    pieces = ["a", " ", "\t", "\n", "\r\n", "\xa0", "\x00", "ß", " ", "Page ", "--- page ", "."]
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choices(pieces, k=40)) for _ in range(300)]

    def expected(text):
        lines = [" ".join(x.replace("\x00", "-").split()) for x in text.splitlines()]
        return [x for x in lines if x and not x.startswith(X.IGNORED_LINE_PREFIXES)]

    assert column(texts, X.clean_line_array) == [expected(t) for t in texts]


def test_casefold(column):
    raw = ["ÄÖ Straße", "oﬃce", "ŠĄ"]
    assert column(raw, X.casefold) == [r.casefold() for r in raw]


def test_money_tokens(column):
    raw = [
        "1 €18.00 21% €18.00",
        "US$10.00 due April 27, 2026",
        "abc12 12abc x-5 (7.50)",
        "no digits",
        "9.12345",
    ]
    found = column(raw, lambda c: F.transform(M.money_tokens(c), lambda t: F.trim(t)))
    assert found == [
        ["1", "€18.00", "€18.00"],
        ["US$10.00", "27,", "2026"],
        ["5", "(7.50)"],
        [],
        ["9", "12345"],
    ]


@pytest.mark.parametrize(
    "raw, value",
    [
        ("1,234.50", "1234.50"),
        ("US$ 5", "5"),
        ("-$5.25", "-5.25"),
        ("(12.50)", "-12.50"),
        ("(€12.50)", "-12.50"),
        ("7 eur", "7"),
        ("(5", None),
        ("5)", None),
        ("-(5)", None),
        ("-EUR(5)", None),
        ("1,EUR,5", "15"),
        ("text", None),
        ("21%", "21"),
    ],
)
def test_parse_decimal(column, raw, value):
    (found,) = column([raw], M.parse_decimal)
    assert found == (None if value is None else Decimal(value))


def test_last_decimal_skips_malformed(column):
    raw = ["a 1 b (2", "3) 4", "(5", "US$1 (2.5)", "none"]
    expected = [Decimal(1), Decimal(4), None, Decimal("-2.5"), None]
    assert column(raw, M.last_decimal) == expected
    every = column(raw, M.decimal_values)
    assert [v[-1] if v else None for v in every] == expected


def test_number_forms(column):
    amounts = [Decimal(x) for x in ("147", "147.005", "147.004", "0", "-783.375", "783.375")]
    assert column(amounts, M.money_text, "decimal(28,6)") == [
        "147.00", "147.01", "147.00", "0.00", "-783.38", "783.38",
    ]
    numbers = [Decimal(x) for x in ("300", "2.50", "0", "0.125", "-10")]
    assert column(numbers, M.plain_number, "decimal(28,6)") == ["300", "2.5", "0", "0.125", "-10"]


@pytest.mark.parametrize(
    "raw, iso",
    [
        ("2026-05-08", "2026-05-08"),
        ("2026/5/8", "2026-05-08"),
        ("May 8, 2026", "2026-05-08"),
        ("january 1, 2026", "2026-01-01"),
        ("Jan 1, 2026", "2026-01-01"),
        ("8 May 2026", "2026-05-08"),
        ("8 September 2026", "2026-09-08"),
        ("08-May-2026", "2026-05-08"),
        ("08-August-2026", "2026-08-08"),
        ("", ""),
        ("08/05/2026", "08/05/2026"),
        ("2026-02-30", "2026-02-30"),
        ("Some Friday", "Some Friday"),
        (" 2026-05-08 ", "2026-05-08"),
    ],
)
def test_to_iso_date(column, raw, iso):
    assert column([raw], to_iso_date) == [iso]


def test_keys(column):
    keys = ["a.pdf", "x/y.tar.gz", "plain", ".hidden", "dir.v1/f", "a//b/./c.PDF", "x.", "/q.pdf"]
    assert column(keys, K.output_key) == [
        "a.xml", "x/y.tar.xml", "plain.xml", ".hidden.xml", "dir.v1/f.xml", "a/b/c.xml", "x..xml",
        "/q.xml",
    ]
    assert column(["/a/../b.pdf", "", "..", "./x"], K.safe_key) == [
        "a/b.pdf", "invoice.pdf", "invoice.pdf", "x",
    ]
    assert column(["../a.pdf"], K.error_report_key) == ["failed/a.pdf.error.json"]
    assert column(["Invoices@any.test"], K.mailbox_of) == ["Invoices"]
    assert column(["A.PDF", "a.pdf.txt"], K.is_pdf_name) == [True, False]


def test_labels(column):
    low = lambda c: X.casefold(c)
    raw = ["Seller: Acme -", "x / SELLER #9/", "nothing"]
    assert column(raw, lambda c: X.value_after_label(c, low(c), "Seller")) == ["Acme", "9", ""]
    assert column(["a / B c", "plain"], X.english_side) == ["B c", "plain"]
    assert column(["plain", "it's", 'a "b"', "both ' \""], X.quoted) == [
        repr(v) for v in ("plain", "it's", 'a "b"', "both ' \"")
    ]


def test_lines_are_cut_as_by_one_pattern(column):
    """Random mixtures of blanks, breaks and letters against the cut as a single pattern."""
    pick = random.Random(5)
    pieces = ["a", "é", "€", " ", " ", "\n", "\n", "\r\n", "\t", "\x0b", "\x1e", "\x1f", "\u0085", " ", " ", " "]
    texts = ["".join(pick.choices(pieces, k=pick.randrange(24))) for _ in range(2000)]
    white = f"[{X.BREAKS}{X.BLANKS}]"
    cut = lambda x: F.filter(F.split(F.trim(x), rf"{white}*[{X.BREAKS}]{white}*"), lambda v: v != "")
    plain = lambda x: F.transform(cut(x), lambda v: F.trim(F.regexp_replace(v, rf"[{X.BLANKS}]+", " ")))
    whole = lambda x: F.filter(plain(x), lambda v: v != "")
    assert column(texts, X.clean_line_array) == column(texts, whole)


def test_the_cut_of_lines_compiles_no_pattern_for_a_row(spark):
    frame = spark.createDataFrame([("a",)], "x string").select(X.clean_line_array(F.col("x")))
    assert ", \n, -1)" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_need_no_pattern_at_line_ends(spark):
    """A pattern that looks behind at every line end took most of the time of all parsing queries."""
    frame = spark.createDataFrame([("a",)], "x string").select(X.clean_line_array(F.col("x")))
    assert "(?<= )" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_rare_blanks_and_breaks_are_found_by_their_bytes(column):
    """Every blank and break there is, alone and beside others, between letters of one to three bytes."""
    blanks = [" ", "\t", "\x1f", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000"]
    breaks = ["\n", "\x0b", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    for a in ("a", "é", "€"):
        texts = [f"{a}{x}{y}{a}" for x in blanks for y in ("", *blanks)]
        assert column(texts, X.clean_line_array) == [[f"{a} {a}"]] * len(texts)
        texts = [f"{x}{a}{x}{y}{z}{a}{y}" for x in blanks for y in breaks for z in (" ", "\u2003", "\r")]
        assert column(texts, X.clean_line_array) == [[a, a]] * len(texts)
    assert column(["a\u2013b\u200b\u2060c", None], X.clean_line_array) == [["a\u2013b\u200b\u2060c"], None]
