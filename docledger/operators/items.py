"""Line items of a document.

Fixed layouts are strides over the line array. Free tables are gaps and islands: the
lines that end a group are found first, then each group is the slice between one end
and the one before, so the work stays linear in the number of lines.

Every builder returns ``struct<rows, error>`` or an array of rows; a row carries its
own error text until the document is finished.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions import money as M
from docledger.functions.binding import first_present, let, position_of, positions
from docledger.functions.text import quoted, starts_with_any
from docledger.operators import lookups as L
from docledger.operators.lookups import Doc
from docledger.schemas import AMOUNT, RATE

# ---- fixed values ----
SKU = r"^[A-Z]{2}-\d{4}$"
US_RATE = 8
COMPACT_STOPS = (
    "subtotal",
    "total excluding tax",
    "tax",
    "vat ",
    "sales tax",
    "total",
    "amount due",
    "balance due",
)
STACKED_STOPS = ("subtotal", "discount", "shipping", "tax", "total", "notes", "terms")
NUMBER_CELL = r"-?\d+(?:\.\d+)?"
PRICED = rf"({NUMBER_CELL})\s+({M.MONEY})\s+(?:({NUMBER_CELL})%\s+)?({M.MONEY})$"
INLINE_ROW = rf"^(.+?)\s+{PRICED}"
NUMBER_ROW = rf"^{PRICED}"
NO_TEXT = "Unclassified charges"
JOINER = " - "
# ----------------------

# Every text that a row pattern matches ends like this; only those are worth the pattern.
ROW_END = r"[\d,]\)?\s*(?:EUR|USD|GBP)?$"
_CUT = "\x1f"  # cannot occur in a cleaned line
ROW_TYPE = (
    "struct<sku:string,description:string,quantity:decimal(28,6),unit_price:decimal(28,6),"
    "vat_rate:decimal(9,4),line_total:decimal(28,6),error:string>"
)
LINES_TYPE = (
    "array<struct<sku:string,description:string,quantity:decimal(28,6),"
    "unit_price:decimal(28,6),vat_rate:decimal(9,4),line_total:decimal(28,6)>>"
)


def unreadable(text: Column) -> Column:
    return F.concat(F.lit("Could not parse decimal value "), quoted(text))


def _row(
    description: Column,
    quantity: Column,
    unit_price: Column,
    vat_rate: Column,
    line_total: Column,
    *,
    sku: Column | None = None,
    error: Column | None = None,
) -> Column:
    nothing = F.lit(None).cast("string")

    def checked(v: Column) -> Column:
        rate = v["rate"].try_cast(RATE)
        exact = F.when(rate == v["rate"], rate)
        complete = (
            v["quantity"].isNotNull()
            & v["unit_price"].isNotNull()
            & exact.isNotNull()
            & v["line_total"].isNotNull()
        )
        lost = F.when(
            v["rate"].isNotNull() & exact.isNull(), unreadable(M.plain_number(v["rate"]))
        ).otherwise(F.lit("Could not parse decimal value"))
        return F.struct(
            (nothing if sku is None else sku).alias("sku"),
            description.alias("description"),
            v["quantity"].alias("quantity"),
            v["unit_price"].alias("unit_price"),
            exact.alias("vat_rate"),
            v["line_total"].alias("line_total"),
            F.when(~complete, F.coalesce(nothing if error is None else error, lost)).alias("error"),
        )

    # No row is left incomplete without saying so.
    values = F.struct(
        quantity.cast(AMOUNT).alias("quantity"),
        unit_price.cast(AMOUNT).alias("unit_price"),
        vat_rate.cast(AMOUNT).alias("rate"),
        line_total.cast(AMOUNT).alias("line_total"),
    )
    return let(values, checked)


def _no_rows() -> Column:
    return F.array().cast(f"array<{ROW_TYPE}>")


def first_row_error(rows: Column) -> Column:
    return F.get(F.filter(rows, lambda r: r["error"].isNotNull()), F.lit(0))["error"]


def finished(rows: Column) -> Column:
    """Rows without their error field."""
    return F.transform(
        rows,
        lambda r: F.struct(
            *[
                r[name].alias(name)
                for name in (
                    "sku",
                    "description",
                    "quantity",
                    "unit_price",
                    "vat_rate",
                    "line_total",
                )
            ]
        ),
    )


def _cells_row(doc: Doc, at: Column, cells: int, incomplete: str, first: int, rate=None) -> Column:
    """Row whose description stands at ``at + first`` and its numbers right below.

    ``cells`` numbers follow: quantity, unit price, rate (unless fixed), line total.
    """

    def value(k: int) -> Column:
        return F.get(doc.lines, at + first + k)

    number = [M.parse_decimal(value(k)) for k in range(1, cells + 1)]
    broken = F.coalesce(
        *[
            F.when(value(k).isNull(), F.lit(incomplete)).when(
                number[k - 1].isNull(), unreadable(value(k))
            )
            for k in range(1, cells + 1)
        ]
    )
    rate_value = number[2] if rate is None else F.lit(rate).cast(AMOUNT)
    return _row(
        value(0),
        number[0],
        number[1],
        rate_value,
        number[-1],
        sku=F.get(doc.lines, at) if first else None,
        error=broken,
    )


def _table(rows: Column, empty: str) -> Column:
    """struct<rows, error>: the first row error, or the message for an empty table."""
    return let(
        rows,
        lambda r: F.struct(
            r.alias("rows"),
            F.when(F.size(r) == 0, F.lit(empty)).otherwise(first_row_error(r)).alias("error"),
        ),
    )


def _strided(first: Column, stop: Column, step: int) -> Column:
    """Row starts first, first+step, ... below ``stop`` (0-based)."""
    return F.when(first < stop, F.sequence(first, stop - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def stride_table(doc: Doc, start: str, stop: str, step: int) -> Column:
    """Rows of ``step`` lines between an exact start label and the next exact stop label."""
    first = position_of(doc.lines, start)
    rest = F.slice(doc.lines, first + 1, F.size(doc.lines))
    last = first + position_of(rest, stop) - 1

    def build(bounds: Column) -> Column:
        def row(at: Column) -> Column:
            return _cells_row(
                doc, at, step - 1, "Incomplete invoice table line", 0, None if step == 5 else US_RATE
            )

        anchors = _strided(bounds["first"], bounds["last"], step)
        return F.when(
            bounds["last"].isNull(),
            F.struct(_no_rows().alias("rows"), F.lit("Missing table boundary").alias("error")),
        ).otherwise(_table(F.transform(anchors, row), "No invoice table lines found"))

    return let(F.struct(first.alias("first"), last.alias("last")), build)


def credit_rows(doc: Doc) -> Column:
    """Rows of five lines after "Credit amount" until a line starting "Subtotal credit"."""
    first = position_of(doc.lines, "Credit amount")
    size = F.size(doc.lines)

    def build(at: Column) -> Column:
        # The stop test happens at row starts only, not inside a row.
        anchors = _strided(at, size, 5)

        def bounded(starts: Column) -> Column:
            stops = F.filter(
                starts, lambda i: F.get(doc.lines, i).startswith("Subtotal credit")
            )
            stop = F.coalesce(F.get(stops, F.lit(0)), size)
            return let(stop, lambda s: F.filter(starts, lambda i: i < s))

        rows = F.transform(
            let(anchors, bounded), lambda i: _cells_row(doc, i, 4, "Incomplete credit note line", 0)
        )
        return F.when(
            at.isNull(),
            F.struct(
                _no_rows().alias("rows"), F.lit("Missing credit note line header").alias("error")
            ),
        ).otherwise(_table(rows, "No credit note lines found"))

    return let(first, build)


#: Anchors of a run that are walked together: what is kept of them is copied with each step, what came before is not.
WALK = 256


def _walked(anchors: Column, start: Column, end: Column, width: int) -> Column:
    """Kept anchors of the run at ``start`` to ``end``, part by part; between parts only the last kept one goes on.

    Anchors are fetched one by one: a slice would copy the whole array.
    """
    none = F.lit(None).cast("int")

    def part(state: Column, begin: Column) -> Column:
        own = F.aggregate(
            F.sequence(begin, F.least(begin + WALK, end) - 1),
            F.struct(state["last"].alias("last"), F.array().cast("array<int>").alias("kept")),
            lambda t, i: F.when(
                t["last"].isNull() | (F.get(anchors, i) - t["last"] >= width),
                F.struct(
                    F.get(anchors, i).alias("last"),
                    F.concat(t["kept"], F.array(F.get(anchors, i))).alias("kept"),
                ),
            ).otherwise(t),
        )
        return let(
            own,
            lambda o: F.struct(
                o["last"].alias("last"), F.concat(state["parts"], F.array(o["kept"])).alias("parts")
            ),
        )

    empty = F.struct(none.alias("last"), F.array().cast("array<array<int>>").alias("parts"))
    begins = F.sequence(start, end - 1, F.lit(WALK))
    walked = F.aggregate(begins, empty, part, lambda s: F.flatten(s["parts"]))
    return F.when(end - start == 1, F.array(F.get(anchors, start))).otherwise(walked)


def _greedy(anchors: Column, width: int) -> Column:
    """Anchors that do not fall inside the row of an earlier kept anchor.

    Only runs of anchors closer than ``width`` interact, so each run is walked alone.
    """

    def by_runs(a: Column) -> Column:
        run_starts = F.filter(
            positions(F.size(a)),
            lambda j: (j == 0) | (F.get(a, j) - F.get(a, j - 1) >= width),
        )

        def walk(starts: Column) -> Column:
            def run(begin: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1), F.size(a))
                return _walked(a, begin, end, width)

            return F.flatten(F.transform(starts, run))

        return let(run_starts, walk)

    return let(anchors, by_runs)


def sku_rows(doc: Doc) -> Column:
    """Rows of six lines, each starting with an article number."""
    anchors = F.filter(
        positions(F.size(doc.lines)), lambda i: F.get(doc.lines, i).rlike(SKU)
    )
    rows = F.transform(
        _greedy(anchors, 6), lambda i: _cells_row(doc, i, 4, "Incomplete SKU invoice line", 1)
    )
    return _table(rows, "No SKU invoice lines found")


def _price_cells(line: Column) -> Column:
    """array(description, quantity, unit, rate, amount) of a table row, NULL otherwise.

    One regex pass both tests the line and cuts it.
    """

    def cut(pattern: str, groups: int) -> Column:
        joined = _CUT.join(f"${k}" for k in range(1, groups + 1))
        return F.split(F.regexp_replace(line, pattern, joined), _CUT)

    inline = let(cut(INLINE_ROW, 5), lambda c: F.when(F.size(c) == 5, c))
    number = let(
        cut(NUMBER_ROW, 4),
        lambda c: F.when(F.size(c) == 4, F.concat(F.array(F.lit(None).cast("string")), c)),
    )
    return F.when(line.rlike(ROW_END), F.coalesce(inline, number))


def compact_table(doc: Doc) -> Column:
    """Rows ``text qty unit [rate%] amount``, or text lines followed by such numbers."""
    is_header = lambda x: x.contains("description") & x.contains("amount")
    headers = F.filter(
        positions(F.size(doc.low)), lambda i: is_header(F.get(doc.low, i))
    )

    def from_header(start: Column) -> Column:
        stops = F.filter(
            positions(F.size(doc.low)),
            lambda i: (i > start)
            & starts_with_any(F.get(doc.low, i), COMPACT_STOPS)
            & ~is_header(F.get(doc.low, i)),
        )
        # Cells of the lines below the first header, up to the stop.
        return let(
            F.coalesce(F.get(stops, F.lit(0)), F.size(doc.low)),
            lambda stop: let(
                F.transform(
                    F.slice(doc.lines, start + 1, stop - start),
                    lambda x, k: F.when(~is_header(F.get(doc.low, start + k)), _price_cells(x)),
                ),
                lambda cells: rows_of(start, cells),
            ),
        )

    def rows_of(start: Column, cells: Column) -> Column:
        # Positions are relative to the first header.
        ends = F.filter(
            positions(F.size(cells)),
            lambda k: F.get(cells, k).isNotNull() | is_header(F.get(doc.low, start + k)),
        )

        def build(e: Column) -> Column:
            def row(k: Column, j: Column) -> Column:
                before = F.get(e, j - 1)
                text = F.slice(doc.lines, start + before + 2, k - before - 1)
                return let(
                    F.struct(F.get(cells, k).alias("cell"), text.alias("text")),
                    lambda v: F.when(
                        v["cell"].isNotNull()
                        & (F.get(v["cell"], F.lit(0)).isNotNull() | (F.size(v["text"]) > 0)),
                        priced(v["cell"], v["text"]),
                    ),
                )

            return F.filter(F.transform(e, row), lambda r: r.isNotNull())

        return let(ends, build)

    def priced(cell: Column, text: Column) -> Column:
        own = F.get(cell, F.lit(0))
        parts = F.when(own.isNotNull(), F.array_append(text, own)).otherwise(text)
        raw = [F.get(cell, F.lit(k)) for k in range(1, 5)]
        raw[2] = F.when(raw[2] == "", "0").otherwise(raw[2])
        number = [M.parse_decimal(x) for x in raw]
        error = F.coalesce(*[F.when(n.isNull(), unreadable(x)) for n, x in zip(number, raw)])
        return _row(F.array_join(parts, JOINER), *number, error=error)

    guard = doc.folded.contains("description") & doc.folded.contains("amount")
    found = F.when(
        guard,
        let(
            F.get(headers, F.lit(0)),
            lambda start: F.when(start.isNotNull(), from_header(start)),
        ),
    )
    return F.coalesce(found, _no_rows())


def stacked_table_start(doc: Doc) -> Column:
    """0-based first line below a stacked header (one line, or four lines)."""

    def start(x: Column, i: Column) -> Column:
        one_line = (
            (x.contains("item") | x.contains("description"))
            & x.contains("quantity")
            & x.contains("amount")
        )
        four_lines = (
            x.isin("item", "description")
            & F.get(doc.low, i + 1).contains("quantity")
            & F.get(doc.low, i + 3).contains("amount")
        )
        return F.when(one_line, i + 1).when(four_lines, i + 4)

    guard = doc.folded.contains("quantity") & doc.folded.contains("amount")
    return F.when(guard, first_present(F.transform(doc.low, start)))


def stacked_table(doc: Doc) -> Column:
    """Text lines, then a quantity line and two amount lines, repeated until a stop line."""
    size = F.size(doc.lines)

    def from_start(start: Column) -> Column:
        def is_stop(i: Column) -> Column:
            return starts_with_any(F.get(doc.low, i), STACKED_STOPS)

        def has_amount(i: Column) -> Column:
            return F.get(doc.amounts, i).isNotNull()

        def is_row(q: Column) -> Column:
            # Decided by the lines around the quantity alone; rows cannot overlap.
            return (
                (q > start)
                & (q + 2 < size)
                & M.is_quantity(F.get(doc.lines, q))
                & ~has_amount(q - 1)
                & ~is_stop(q - 1)
                & has_amount(q + 1)
                & has_amount(q + 2)
            )

        breaks = F.filter(
            positions(size), lambda i: (i >= start) & (has_amount(i) | is_stop(i))
        )

        def build(b: Column) -> Column:
            # A stop line that serves as a price of a row does not stop.
            stops = F.filter(
                b,
                lambda i: is_stop(i)
                & ~F.coalesce(is_row(i - 1), F.lit(False))
                & ~F.coalesce(is_row(i - 2), F.lit(False)),
            )
            return let(F.coalesce(F.get(stops, F.lit(0)), size), lambda stop: rows(b, stop))

        def rows(b: Column, stop: Column) -> Column:
            def row(q: Column, j: Column) -> Column:
                before = F.when(j == 0, start - 1).otherwise(F.get(b, j - 1))
                text = F.array_join(F.slice(doc.lines, before + 2, q - before - 1), JOINER)
                return F.when(
                    (q < stop) & is_row(q),
                    _row(
                        text,
                        M.parse_decimal(F.get(doc.lines, q)),
                        F.get(doc.amounts, q + 1),
                        F.lit(0).cast(AMOUNT),
                        F.get(doc.amounts, q + 2),
                    ),
                )

            return F.filter(F.transform(b, row), lambda r: r.isNotNull())

        return let(breaks, build)

    found = let(
        stacked_table_start(doc), lambda s: F.when(s.isNotNull(), from_start(s))
    )
    return F.coalesce(found, _no_rows())


def labeled_amount_rows(doc: Doc) -> Column:
    """Priced exam, then promotion or adjustment; those that are present."""
    one, zero = F.lit(1).cast(AMOUNT), F.lit(0).cast(AMOUNT)
    price = L.inline_amount(doc, L.EXAM_PRICE_LABELS)
    name = F.coalesce(L.inline_value(doc, L.EXAM_NAME_LABELS), F.lit("Exam Price"))
    adjustment = L.inline_amount(doc, L.ADJUSTMENT_LABELS)

    def build(v: Column) -> Column:
        label = F.when(v["adjustment"] < 0, "Promotion Amount").otherwise("Adjustment")
        rows = F.array(
            F.when(v["price"].isNotNull(), _row(name, one, v["price"], zero, v["price"])),
            F.when(
                v["adjustment"].isNotNull(),
                _row(label, one, v["adjustment"], zero, v["adjustment"]),
            ),
        )
        return F.array_compact(rows)

    return let(F.struct(price.alias("price"), adjustment.alias("adjustment")), build)


def fallback_row(doc: Doc, subtotal: Column, rate: Column) -> Column:
    text = F.coalesce(L.description(doc), F.lit(NO_TEXT))
    return F.array(_row(text, F.lit(1).cast(AMOUNT), subtotal, rate, subtotal))


def generic_rows(doc: Doc, subtotal: Column, rate: Column) -> Column:
    """First of: stacked table, compact table, labelled amounts, one fallback row."""
    return let(
        stacked_table(doc),
        lambda s: F.when(F.size(s) > 0, s).otherwise(
            let(
                compact_table(doc),
                lambda c: F.when(F.size(c) > 0, c).otherwise(
                    let(
                        labeled_amount_rows(doc),
                        lambda a: F.when(F.size(a) > 0, a).otherwise(
                            fallback_row(doc, subtotal, rate)
                        ),
                    )
                ),
            )
        ),
    )
